"""Records of XML files of any size: one file is read by many tasks, whatever its cuts run through.

Spark's text reader, told that lines end in ``<``, gives a file's pieces between these, each in the split that it starts in. A
piece means different things in a comment, a CDATA section, an instruction, a declaration or between tags, and where a split
starts isn't known until all before it is read. So each split is read for every state it might start in at once: its summary
is the state it ends in and the elements it leaves open, for each start. Composing the summaries in order gives each split's true
start, and the second reading cuts out the records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.sources.store import discard, stored

#: Between tags; in a comment, CDATA, an instruction; in a DOCTYPE before its subset; in its subset, a comment, an instruction or a quoted value there; in a quoted identifier before it.
OUTSIDE, COMMENT, CDATA, INSTRUCTION, DOCTYPE, SUBSET, SUBSET_COMMENT, SUBSET_INSTRUCTION, DOUBLE, SINGLE, ID_DOUBLE, ID_SINGLE = STATES = range(12)
OPEN, CLOSE, EMPTY = "open", "close", "empty"

_ENDS = {COMMENT: ("-->", OUTSIDE), CDATA: ("]]>", OUTSIDE), INSTRUCTION: ("?>", OUTSIDE), SUBSET_COMMENT: ("-->", SUBSET), SUBSET_INSTRUCTION: ("?>", SUBSET)}
_QUOTES = {DOUBLE: ('"', SUBSET), SINGLE: ("'", SUBSET), ID_DOUBLE: ('"', DOCTYPE), ID_SINGLE: ("'", DOCTYPE)}
_MARKS = {DOCTYPE: re.compile(r"""["'\[>]"""), SUBSET: re.compile(r"""["']|\]\s*>""")}
#: What a piece must hold to end a state (of those not here, any piece may).
_NEEDED = {s: mark for s, (mark, _) in (_ENDS | _QUOTES).items()}


def _declared(state: int, piece: str, at: int) -> int:
    """State after ``piece`` from ``at``, in or below a DOCTYPE."""
    while True:
        if state in _QUOTES:
            mark, back = _QUOTES[state]
            end = piece.find(mark, at)
            if end < 0:
                return state
            state, at = back, end + 1
        elif state in _ENDS:
            mark, back = _ENDS[state]
            end = piece.find(mark, at)
            if end < 0:
                return state
            state, at = back, end + len(mark)
        elif state == OUTSIDE:
            return state
        else:
            found = _MARKS[state].search(piece, at)
            if not found:
                return state
            at, mark = found.end(), found.group()[0]
            if mark == "[":
                state = SUBSET
            elif mark in ">]":
                state = OUTSIDE
            else:
                state = {(DOCTYPE, '"'): ID_DOUBLE, (DOCTYPE, "'"): ID_SINGLE, (SUBSET, '"'): DOUBLE, (SUBSET, "'"): SINGLE}[state, mark]


class Lexer:
    """What a piece (the text after a ``<``, up to the next) does for the elements of one name."""

    def __init__(self, tag: str) -> None:
        name = re.escape(tag)
        self.open = re.compile(rf"""{name}(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>""")
        self.close = re.compile(rf"/{name}\s*>")
        self.first = tag[0]

    def after(self, state: int, piece: str) -> tuple[int, str | None]:
        """The state after the piece, and whether a tag of the name opens, closes or is empty."""
        if state == OUTSIDE:
            head = piece[:1]
            if head == self.first:
                if found := self.open.match(piece):
                    return state, EMPTY if found.group().endswith("/>") else OPEN
            elif head == "/":
                return state, CLOSE if self.close.match(piece) else None
            elif head == "!":
                if piece.startswith("!--"):
                    return (OUTSIDE if piece.find("-->", 3) >= 0 else COMMENT), None
                if piece.startswith("![CDATA["):
                    return (OUTSIDE if piece.find("]]>", 8) >= 0 else CDATA), None
                if piece.startswith("!DOCTYPE"):
                    return _declared(DOCTYPE, piece, 8), None
            elif head == "?":
                return (OUTSIDE if piece.find("?>", 1) >= 0 else INSTRUCTION), None
            return state, None
        if state == SUBSET:
            if piece.startswith("!--"):
                return _declared(SUBSET_COMMENT, piece, 3), None
            if piece.startswith("?"):
                return _declared(SUBSET_INSTRUCTION, piece, 1), None
        return _declared(state, piece, 0), None


def _blocks(batches: Iterator[pd.DataFrame], *more: str) -> Iterator[tuple[bool, tuple, str]]:
    """(whether a new split starts, its columns, piece) in the order of the rows."""
    key = None
    for batch in batches:
        columns = [batch[c] for c in ("file", "block", *more)]
        for *row, piece in zip(*columns, batch["value"]):
            fresh = row[:2] != key
            key = row[:2]
            yield fresh, tuple(row), piece


def _summaries(tag: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexer = Lexer(tag)
        done, key, now, depth = [], None, [], []
        row = lambda: (*key, list(now), list(depth))
        for fresh, at, piece in _blocks(batches):
            if fresh:
                if key:
                    done.append(row())
                # Starts that reached one state go on as one: ``now`` has the state of each start, ``states`` the distinct ones.
                key, now, depth = at, list(STATES), [0] * len(STATES)
                states = set(now)
                if at[1] == 0:
                    continue  # what stands before the file's first "<"
            moved = {}
            for s in states:
                needed = _NEEDED.get(s)
                if needed is None or needed in piece:
                    to, tagged = lexer.after(s, piece)
                    if tagged in (OPEN, CLOSE):
                        step = 1 if tagged == OPEN else -1
                        depth = [d + step if n == OUTSIDE else d for d, n in zip(depth, now)]
                    if to != s:
                        moved[s] = to
            if moved:
                now = [moved.get(n, n) for n in now]
                states = set(now)
        if key:
            done.append(row())
        yield pd.DataFrame(done, columns=["file", "block", "ends", "depths"])

    return run


def _starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """True state and open elements at the start of each split of one file (a row a split: some 8,000 for 1 TB)."""
    state, depth, rows = OUTSIDE, 0, []
    for file, block, ends, depths in blocks.sort_values("block")[["file", "block", "ends", "depths"]].itertuples(index=False):
        rows.append((file, block, state, depth))
        depth += depths[state]
        state = ends[state]
    return pd.DataFrame(rows, columns=["file", "block", "state", "depth"])


def _cut(tag: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexer = Lexer(tag)
        out, size, key, nr, parts, begun = [], 0, None, 0, None, False

        def emit(last: bool) -> None:
            nonlocal nr, parts, size
            text = "".join(parts)
            out.append((*key, nr, begun, last, text))
            nr, parts, size = nr + 1, None, size + len(text)

        def batch() -> pd.DataFrame:
            nonlocal out, size
            frame, out, size = pd.DataFrame(out, columns=["file", "block", "nr", "first", "last", "text"]), [], 0
            return frame

        for fresh, at, piece in _blocks(batches, "state", "depth"):
            if fresh:
                if parts is not None:
                    emit(False)
                if at[2] != at[2]:
                    raise ValueError(f"{at[0]} was split in another way the second time; keep spark.sql.files.maxPartitionBytes as it was")
                key, nr, state, depth = at[:2], 0, int(at[2]), int(at[3])
                parts, begun = ([] if depth > 0 else None), False
                if at[1] == 0:
                    continue
            state, tagged = lexer.after(state, piece)
            if parts is not None:
                depth += {OPEN: 1, CLOSE: -1}.get(tagged, 0)
                if depth:
                    parts.append("<" + piece)
                else:
                    parts.append("<" + piece[: piece.index(">") + 1])
                    emit(True)
            elif tagged == OPEN:
                depth += 1
                if depth == 1:
                    parts, begun = ["<" + piece], True
            elif tagged == EMPTY and depth == 0:
                parts, begun = ["<" + lexer.open.match(piece).group()], True
                emit(True)
            elif tagged == CLOSE:
                depth -= 1
            if size > 4_000_000:
                yield batch()
        if parts is not None:
            emit(False)
        yield batch()

    return run


def read_records(spark: SparkSession, paths: str | Sequence[str], tag: str, *, broadcast_blocks: int = 500_000) -> DataFrame:
    """The outermost elements named ``tag`` (as written, prefix included) in XML files in UTF-8: ``file``, ``block``, ``nr``, ``complete``, ``text``.

    ``block`` (where the split starts) and ``nr`` give the order in a file. Tags in comments, CDATA sections, instructions and
    DOCTYPE are no records. A record that its file ends in is returned with ``complete`` false. Files need no root element; one without
    such elements, or an empty one, gives no rows. Where closing tags outnumber the opening ones, records start
    again when the difference is made up. Compressed files are one split each.

    The files are read twice, never shuffled. The splits' start states are broadcast for up to ``broadcast_blocks`` splits (some 64 TB with splits
    of 128 MB, about 50 MB), and joined by shuffle beyond that. Only the parts of records that lie across splits are grouped.
    """
    lines = spark.read.text(paths, lineSep="<")
    pieces = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    summaries = pieces.mapInPandas(_summaries(tag), "file string, block long, ends array<int>, depths array<long>")
    starts = stored(summaries.groupBy("file").applyInPandas(_starts, "file string, block long, state int, depth long"), "record-starts")
    if starts.count() <= broadcast_blocks:
        placed = pieces.join(F.broadcast(starts), ["file", "block"], "left")
    else:
        placed = pieces.withColumn("at", F.monotonically_increasing_id()).join(starts, ["file", "block"], "left")
        placed = placed.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    parts = stored(placed.select("value", "file", "block", "state", "depth").mapInPandas(_cut(tag), "file string, block long, nr long, first boolean, last boolean, text string"), "record-parts")
    discard(starts)
    whole = parts.where("first and last").select("file", "block", "nr", F.lit(True).alias("complete"), "text")
    before = Window.partitionBy("file").orderBy("block", "nr")
    torn = parts.where("not (first and last)").withColumn("head", F.last(F.when(F.col("first"), F.struct("block", "nr")), ignorenulls=True).over(before))
    pieces_of = F.array_sort(F.collect_list(F.struct("block", "nr", "text")))
    joined = torn.groupBy("file", "head").agg(F.bool_or("last").alias("complete"), F.array_join(F.transform(pieces_of, lambda t: t["text"]), "").alias("text"))
    return whole.unionByName(joined.select("file", "head.block", "head.nr", "complete", "text"))


def stream_records(spark: SparkSession, folder: str, tag: str, sink, checkpoint: str, *, files_per_batch: int = 1000):
    """Starts a stream over files that arrive in ``folder``: ``sink(records, batch_id)`` gets the records of each micro-batch's files, as ``read_records`` gives them.

    The checkpoint remembers which files were taken, so a stream that starts again goes on behind them; as with any ``foreachBatch``, a batch that was cut off
    comes again under its number. Returns the StreamingQuery (with all files at hand as its trigger). A batch's names, at most
    ``files_per_batch``, pass through the driver.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    names = names.option("maxFilesPerTrigger", files_per_batch).load(folder).where("length > 0").select("path")

    def each(batch: DataFrame, batch_id: int) -> None:
        found = [r.path for r in batch.collect()]
        if found:
            sink(read_records(batch.sparkSession, found, tag), batch_id)

    return names.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
