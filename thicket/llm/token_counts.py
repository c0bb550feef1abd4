"""Token counts of every prefix, by dynamic programming.

A SentencePiece BPE model never merges across the start of a run of spaces, so a
text falls into units (a run of spaces and the characters up to the next run).
In a unit, every prefix has exactly one last token: the token that ends there
and that byte-pair encoding would leave beside the last token of the rest. That
gives the recurrence ``count[p] = count[p - len(t)] + 1`` (for characters outside
the vocabulary: plus their number of UTF-8 bytes), hence the exact count at every
prefix, and answers to truncation and budget questions without encoding again.
Units repeat, so each worker keeps a memo of their counts, bounded by bytes. New units
are taken in their order, so the recurrence goes on from the prefix that a unit shares
with the one before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from thicket.llm.common import KEPT, LONG, Memo, claim

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"
_UNITS = re.compile(r" *[^ ]+| +$")


class PrefixCounter:
    """Exact token counts of prefixes under a SentencePiece BPE model without text normalisation."""

    def __init__(self, model_file: str, room: int = 192 << 20):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        # Tokens by their characters from the last to the first; "" marks where one begins.
        self.backwards: dict = {}
        for t in self.score:
            node = self.backwards
            for char in reversed(t):
                node = node.setdefault(char, {})
            node[""] = t
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reach: dict[str, bool] = {}  # no more than the vocabulary
        self.totals, self.most_pairs = Memo(room), room // 320

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding of a short string by its definition: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _beside(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= self.most_pairs:  # two tokens each
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def _token(self, t: str) -> bool:
        got = self.reach.get(t)
        if got is None:
            got = self.reach[t] = self.merged(t) == [t]
        return got

    def _extend(self, unit: str, last: list[str], count: list[int]) -> None:
        """Goes on with the recurrence over ``unit``, whose first len(last) - 1 characters are done."""
        score, backwards, beside, token = self.score, self.backwards, self._beside, self._token
        for p in range(len(last), len(unit) + 1):
            char = unit[p - 1]
            if char not in score:
                last.append("")
                count.append(count[-1] + len(char.encode()))
                continue
            node, q, found = backwards, p, []
            while q:
                q -= 1
                node = node.get(unit[q])
                if node is None:
                    break
                if "" in node:
                    found.append((q, node[""]))
            for q, t in reversed(found):  # the longest first
                if (not last[q] or beside(last[q], t)) and token(t):
                    last.append(t)
                    count.append(count[q] + 1)
                    break
            else:
                raise ValueError(f"no last token at {p} of {unit!r}")

    def prefixes(self, unit: str) -> tuple[int, ...]:
        """Counts for ``unit[:1]``, ``unit[:2]``, ... of one unit, in which spaces are written as U+2581."""
        last, count = [""], [0]
        self._extend(unit, last, count)
        return tuple(count[1:])

    def learn(self, units: set[str]) -> list[str]:
        """Puts the totals of units (without their first space) into the memo; returns the long ones."""
        before, last, count, totals = "", [""], [0], {}
        for key in sorted(units):
            unit = "\u2581" + key.replace(" ", "\u2581")
            k, most = 0, min(len(before), len(unit))
            while k < most and before[k] == unit[k]:
                k += 1
            del last[k + 1 :], count[k + 1 :]
            self._extend(unit, last, count)
            totals[key] = count[-1]
            before = unit
        self.totals.put(totals, sum(map(len, units)))
        return [u for u in units if len(u) > LONG]

    def total(self, unit: str) -> int:
        got = self.totals.young.get(unit)
        return self.prefixes("\u2581" + unit.replace(" ", "\u2581"))[-1] if got is None else got

    def split(self, text: str) -> list[str]:
        """Units without their first space."""
        if "▁" in text:
            text = text.replace("▁", " ")
        if "  " not in text and text[:1] != " ":
            return text.split(" ")
        return [u[1:] for u in _UNITS.findall(" " + text)]

    def count_all(self, texts: list[str], some: int = 1000) -> list[int]:
        """Exact token counts of whole texts."""
        out = []
        for i in range(0, len(texts), some):
            split = [self.split(t) if t else () for t in texts[i : i + some]]
            new = self.totals.missing(set().union(*split))
            long = self.learn(new) if new else ()
            get = self.totals.young.__getitem__
            out += [sum(map(get, units)) for units in split]
            self.totals.forget(long)
        return out

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_prefixes(self, text: str) -> list[int]:
        """Token counts of ``text[:0]``, ``text[:1]``, ..., ``text``."""
        out, base = [0], 0
        if text:
            for u in self.split(text):
                c = self.prefixes("▁" + u.replace(" ", "▁"))
                # The first unit's space is the model's own, not a character of the text.
                out += [base + x for x in (c[1:] if len(out) == 1 and base == 0 else c)]
                base += c[-1]
        return out

    def cut(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        if budget <= 0 or not text:
            return 0
        base, start, best = 0, -1, 0
        for u in self.split(text):
            if base >= budget:
                break
            total = self.total(u)
            if base + total <= budget:
                best = start + 1 + len(u)
            else:
                for i, c in enumerate(self.prefixes("▁" + u.replace(" ", "▁"))):
                    if base + c <= budget:
                        best = max(best, start + 1 + i)
            base += total
            start += 1 + len(u)
        return best


@lru_cache(maxsize=1)
def _counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


KEPT["prefixes"] = _counter.cache_clear


def token_counts(docs: DataFrame, model_file: str, limit: int) -> DataFrame:
    """UTF-8 bytes and exact tokens of each text, and where a budget of ``limit`` tokens cuts it.

    Returns one row per row of ``docs`` (also for repeated or null ``doc_id``): ``doc_id``,
    ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit``) and ``cut_chars``, the code
    points of the longest prefix within the limit. A null text counts as empty: 0 bytes,
    0 tokens. Other columns of ``docs`` are not read. Texts are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("prefixes")
        counter = _counter(model_file)
        for batch in batches:
            size, tokens, cut = [], [], []
            for k in range(0, batch.num_rows, 1000):
                texts = [t or "" for t in batch.column(1).slice(k, 1000).to_pylist()]
                size += [len(t.encode()) for t in texts]
                counts = counter.count_all(texts)
                tokens += counts
                cut += [len(t) if n <= limit else counter.cut(t, limit) for t, n in zip(texts, counts, strict=True)]
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(cut, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
