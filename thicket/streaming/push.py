"""Documents that arrive in chunks: Structured Streaming with a state for the open documents of each bucket.

Texts, CDATA sections, comments and instructions are delivered as they come, in pieces (as push parsers do; ``whole_texts`` joins
them), and are never kept. The state is a tag or DOCTYPE that is not complete yet, with where in it the reader stands (so no
character is searched again), and the open elements. The work is in proportion to the input for every construct. Chunks that are
there together are joined once. A document whose last chunk never comes keeps its state.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thicket.operators.paths import DESCENDANT, MOST_STEPS

EVENTS = "doc_id long, seq long, event string, name string, value string, depth int, more boolean"
MATCHES = "doc_id long, seq long, name string, depth int"
STATE = "documents binary"  # of the open documents of a bucket: where the parser stands, open elements, numbers, chunks that wait
BUCKETS = 1 << 10
PIECES = ("text", "cdata", "comment", "instruction")
_TAG = re.compile(r"<(/?)([^\s/<>!?\"']++)((?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*')*+)>")  # a < in a value is not well-formed
_OPENERS = {"<!--": "comment", "<?": "instruction", "<![CDATA[": "cdata", "<!DOCTYPE": "doctype"}
_BEGUN_BY = {kind: opener for opener, kind in _OPENERS.items()} | {"tag": ""}
_ENDS = {"comment": "-->", "instruction": "?>", "cdata": "]]>"}
_NO_NAME = frozenset("/<>!?\"'")
#: Where a tag goes on otherwise: outside of quotes, and inside of either.
_IN_TAG = {"": re.compile("[<>\"']"), '"': re.compile('["<]'), "'": re.compile("['<]")}
#: The same for a DOCTYPE: its own part, its subset, a declaration in that, and behind the subset.
_IN_TYPE = {"own": re.compile(r"[\[\]<>\"']"), "subset": re.compile(r"[\]<]"), "declaration": re.compile("[<>\"']"), "behind": re.compile(r"\S")}


class Parser:
    """Reads a document in pieces; what it knows between two of them is ``state()``.

    ``pieces`` False: comments and the like are kept until they are complete.
    """

    def __init__(self, names: list[str], seq: int = 0, mode: str = "", sub: str = "", held: Sequence[str] = (), carry: str = "", pieces: bool = True):
        self.names, self.seq, self.mode, self.sub, self.held, self.carry, self.pieces = names, seq, mode, sub, list(held), carry, pieces
        self.rows: list[tuple] = []

    def state(self) -> tuple[str, str, list[str], str]:
        return self.mode, self.sub, self.held, self.carry

    def unread(self) -> str:
        """The construct that isn't complete, as far as it is kept."""
        return _BEGUN_BY.get(self.mode, "") + "".join(self.held) + self.carry

    def feed(self, text: str, final: bool = False) -> list[tuple]:
        """Events (number, event, name, value, depth, whether the next event goes on with it) of what is complete now."""
        self.rows, buffer, at, waits = [], self.carry + text, 0, False
        steps = {"": self._outside, "tag": self._tag, "doctype": self._doctype}
        while at < len(buffer) and not waits:
            at, waits = steps.get(self.mode, self._ended)(buffer, at, final)
        self.carry = buffer[at:]
        if final:
            if self.mode in _ENDS and self.pieces:
                self._emit("error", _BEGUN_BY[self.mode], "the document ends in it")
            elif self.mode or self.carry:
                self._emit("error", None, self.unread())
            self._outward()
            self.carry = ""
            if self.names:
                self._emit("error", self.names[-1], "the document ends in an element")
        return self.rows

    def _emit(self, event: str, name: str | None, value: str | None, more: bool = False) -> None:
        self.rows.append((self.seq, event, name, value, len(self.names), more))
        self.seq += 1

    def _outward(self) -> None:
        self.mode, self.sub, self.held = "", "", []

    def _outside(self, buffer: str, at: int, final: bool) -> tuple[int, bool]:
        begin = buffer.find("<", at)
        if begin < 0:
            begin = len(buffer)
        if begin > at:
            self._emit("text", None, buffer[at:begin])
        if begin == len(buffer):
            return begin, False
        if found := _TAG.match(buffer, begin):
            self._element(*found.groups())
            return found.end(), False
        head = buffer[begin : begin + 9]
        for opener, kind in _OPENERS.items():
            if (head.upper() if kind == "doctype" else head).startswith(opener):
                self.mode, self.sub = kind, "own" if kind == "doctype" else ""
                return begin + len(opener), False
        behind = begin + (2 if head[1:2] in ("/", "!") else 1)
        if begin + len(head) == len(buffer) and (head == "</" or any(o.startswith(head.upper()) for o in _OPENERS)):
            return begin, True
        if head[1] == "!" or buffer[behind] in _NO_NAME or buffer[behind].isspace():
            self._emit("error", None, buffer[begin:behind])
        else:
            self.mode, self.held = "tag", [buffer[begin:behind]]
        return behind, False

    def _ended(self, buffer: str, at: int, final: bool) -> tuple[int, bool]:
        """A construct up to the text that ends it."""
        mark = _ENDS[self.mode]
        end = buffer.find(mark, at)
        stop = end if end >= 0 else len(buffer) if final else max(at, len(buffer) - len(mark) + 1)
        self.held.append(buffer[at:stop])
        if end >= 0:
            self._emit(self.mode, None, "".join(self.held))
            self._outward()
            return end + len(mark), False
        if self.pieces and stop > at:
            self._emit(self.mode, None, "".join(self.held), True)
            self.held = []
        return stop, True

    def _wrong(self, buffer: str, at: int, stop: int) -> tuple[int, bool]:
        """What can't become well-formed is an error as far as it was read."""
        self.held.append(buffer[at:stop])
        self._emit("error", None, _BEGUN_BY[self.mode] + "".join(self.held))
        self._outward()
        return stop, False

    def _tag(self, buffer: str, at: int, final: bool) -> tuple[int, bool]:
        found = _IN_TAG[self.sub].search(buffer, at)
        if found and found[0] == "<":
            return self._wrong(buffer, at, found.start())
        stop = found.end() if found else len(buffer)
        self.held.append(buffer[at:stop])
        if found and found[0] == ">":
            self._element(*_TAG.fullmatch("".join(self.held)).groups())
            self._outward()
        elif found:
            self.sub = "" if self.sub else found[0]
        return stop, False

    def _doctype(self, buffer: str, at: int, final: bool) -> tuple[int, bool]:
        part, _, inner = self.sub.partition(" ")
        if inner:  # quotes, a comment or an instruction
            end = buffer.find(inner, at)
            stop = end + len(inner) if end >= 0 else max(at, len(buffer) - len(inner) + 1)
            self.held.append(buffer[at:stop])
            if end >= 0:
                self.sub = part
            return stop, end < 0
        found = _IN_TYPE[part].search(buffer, at)
        stop, mark = (found.end(), found[0]) if found else (len(buffer), "")
        if mark == "<" and part == "subset":
            begin = found.start()
            look = buffer[begin : begin + 4]
            if begin + len(look) == len(buffer) and "<!--".startswith(look) and look != "<!--":
                self.held.append(buffer[at:begin])
                return begin, True
            if look[1] not in "!?":
                return self._wrong(buffer, at, begin)
            self.sub = "subset -->" if look == "<!--" else "subset ?>" if look[1] == "?" else "declaration"
            stop = begin + (4 if look == "<!--" else 2)
        elif mark in ("'", '"') and part in ("own", "declaration"):
            self.sub = f"{part} {mark}"
        elif mark == "[":
            self.sub = "subset"
        elif mark == "]" and part == "subset":
            self.sub = "behind"
        elif mark == ">" and part == "declaration":
            self.sub = "subset"
        elif mark and mark != ">":
            return self._wrong(buffer, at, found.start())
        self.held.append(buffer[at:stop])
        if mark == ">" and part in ("own", "behind"):
            text = "".join(self.held)[:-1].strip()
            name = re.match(r"[^\s\[]*", text)[0]
            self._outward()
            self._emit("doctype", name or None, text[len(name) :].strip() or None)
        return stop, False

    def _element(self, slash: str, name: str, rest: str) -> None:
        if slash:
            if self.names and self.names[-1] == name:
                self.names.pop()
                self._emit("end", name, None)
            else:
                self._emit("error", name, "end tag without a start")
            return
        self._emit("start", name, rest.removesuffix("/").strip() or None)
        if rest.endswith("/"):
            self._emit("end", name, None)
        else:
            self.names.append(name)


def take(tail: str, names: list[str], seq: int, final: bool) -> tuple[list[tuple], str, int]:
    """Events of all complete constructs in ``tail`` (each whole but for texts), what is left of it, and the next number; ``names`` are updated."""
    parser = Parser(names, seq, pieces=False)
    rows = parser.feed(tail, final)
    return [r[:5] for r in rows], parser.unread(), parser.seq


def _pushed(chunks: DataFrame, schema: str, rows_of: Callable[[list[tuple], list[int]], list[tuple]]) -> DataFrame:
    """Rows made of each document's events as they come; ``rows_of`` gets them with a list of numbers that it keeps in the state.

    Documents are dealt over ``BUCKETS`` keys by a hash, and the state of a key holds its open documents: a call for each small document would
    cost more than reading it.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        arrived: dict[int | None, list[tuple]] = {}
        for frame in frames:
            for doc, known, c, content, final in zip(*(frame[n].tolist() for n in ("doc_id", "known", "chunk", "content", "final")), strict=True):
                arrived.setdefault(doc if known else None, []).append((c, ("1" if final else "0") + (content or "")))
        out: list[tuple] = []
        for doc, own in arrived.items():
            *parts, names, masks, seq, chunk, waiting = held.pop(doc, None) or ("", "", [], "", [], [], 0, 0, {})
            waiting.update(own)
            done, ready = False, []
            while chunk in waiting and not done:
                text = waiting.pop(chunk)
                done = text[0] == "1"
                ready.append(text[1:])
                chunk += 1
            parser = Parser(names, seq, *parts)
            if ready:
                out += [(doc, *r) for r in rows_of(parser.feed("".join(ready), done), masks)]
            if not done:
                held[doc] = (*parser.state(), parser.names, masks, parser.seq, chunk, waiting)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
                out = []
        if held:
            state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    # A null among the numbers would make pandas round them all.
    own = chunks.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "chunk", "content", F.coalesce("final", F.lit(False)).alias("final"), F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("_bucket"))
    return own.groupBy("_bucket").applyInPandasWithState(update, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def push_events(chunks: DataFrame) -> DataFrame:
    """Parse events of a stream of ``doc_id, chunk, content, final`` rows (``chunk`` counts from 0).

    Chunks of a document may arrive out of order; they wait for those before them. Events are delivered as soon as their
    constructs are complete, those of ``PIECES`` in pieces, with ``more`` where the next event goes on with a construct (pieces of
    text simply follow each other). CDATA sections are events of their own; references in texts and attributes stay as they are
    (``plain_texts``). A document that ends inside an element or construct, and end tags without a start, give errors; null content is
    empty. An element beside the root is no error here.
    """
    return _pushed(chunks, EVENTS, lambda rows, masks: rows)


def push_matches(chunks: DataFrame, pattern: Sequence[tuple[str, str]]) -> DataFrame:
    """Elements that a pattern selects (see ``operators.paths.matching``), from a stream of chunks as of ``push_events``.

    ``doc_id``, ``seq`` (of the start event), ``name`` and ``depth`` (elements around it), as soon as the start tag is complete. The
    state has the matched steps of each open element as a mask: two names of one path are never compared twice.
    """
    if not 0 < len(pattern) <= MOST_STEPS:
        raise ValueError(f"{len(pattern)} steps")
    stays = sum(1 << i for i, (axis, _) in enumerate(pattern) if axis == DESCENDANT)
    anywhere = sum(1 << i for i, (_, name) in enumerate(pattern) if name == "*")
    by_name: dict[str, int] = {}
    for i, (_, name) in enumerate(pattern):
        by_name[name] = by_name.get(name, 0) | 1 << i

    def rows_of(rows: list[tuple], masks: list[int]) -> list[tuple]:
        out = []
        for seq, event, name, _, depth, _ in rows:
            if event == "start":
                around = masks[-1] if masks else 1
                on = around & (anywhere | by_name.get(name.rpartition(":")[2], 0))
                masks.append(around & stays | on << 1)
                if masks[-1] >> len(pattern) & 1:
                    out.append((seq, name, depth))
            elif event == "end":
                masks.pop()
        return out

    return _pushed(chunks, MATCHES, rows_of)


def whole_texts(events: DataFrame) -> DataFrame:
    """Events with the pieces of each text, CDATA section, comment or instruction as one event, which has the number of its first piece."""
    inner = Window.partitionBy("doc_id").orderBy("seq")
    follows = ((F.col("event") == "text") & (F.lag("event").over(inner) == "text")) | F.lag("more").over(inner)
    numbered = events.withColumn("_run", F.sum(F.when(F.coalesce(follows & (F.col("event") != "error"), F.lit(False)), 0).otherwise(1)).over(inner))
    kind = F.min_by("event", "seq")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda p: p["value"]), "")
    joined = numbered.groupBy("doc_id", "_run").agg(F.min("seq").alias("seq"), kind.alias("event"), F.min_by("name", "seq").alias("name"), F.when(kind.isin(*PIECES), text).otherwise(F.min_by("value", "seq")).alias("value"), F.min_by("depth", "seq").alias("depth"))
    return joined.drop("_run")


#: The entities that every XML document has.
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_REFERENCE = r"&(#[0-9]+|#x[0-9a-fA-F]+|[\p{L}_:][\p{L}\p{N}_:.-]*);"


def unescaped(text: Column) -> Column:
    """``text`` with character references and the predefined entities resolved, each once; others, and numbers that are no character, stay.

    The text is cut at ``&``: each part but the first begins with what may be a reference.
    """

    def part(p: Column) -> Column:
        name = F.regexp_extract(F.concat(F.lit("&"), p), "^" + _REFERENCE, 1)
        digits = F.regexp_replace(name, "^#x?0*", "")
        number = F.when(F.length(digits) > 8, None).when(name.startswith("#x"), F.conv(digits, 16, 10)).when(name.startswith("#"), digits).try_cast("long")
        allowed = number.isin(9, 10, 13) | number.between(0x20, 0xD7FF) | number.between(0xE000, 0xFFFD) | number.between(0x10000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(F.when(allowed, number)), 8, "0")), "UTF-32")
        predefined = F.lit(None).cast("string")
        for entity, stands_for in PREDEFINED.items():
            predefined = F.when(name == entity, stands_for).otherwise(predefined)
        found = F.coalesce(predefined, character)
        return F.when(found.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(found, F.substring(p, F.length(name) + 2, F.length(p))))

    parts = F.split(text, "&")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), part), ""))


def plain_texts(events: DataFrame) -> DataFrame:
    """Whole events (see ``whole_texts``) with references in texts resolved. CDATA sections, where ``&lt;`` is four characters, become texts,
    and texts that follow each other one."""
    own = events.withColumn("value", F.when(F.col("event") == "text", unescaped(F.col("value"))).otherwise(F.col("value")))
    return whole_texts(own.withColumn("event", F.when(F.col("event") == "cdata", "text").otherwise(F.col("event"))).withColumn("more", F.lit(False)))
