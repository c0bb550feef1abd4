"""Exact removal of repeated word windows, partitioned as super-k-mers.

A window is ``width`` consecutive words. Its minimiser is the smallest hash of its word
``m``-grams; consecutive windows with the same minimiser form a super-k-mer, which travels
as one packed string to the bucket of its minimiser, where its windows are sorted. Equal
windows have equal minimisers, so all copies of a window meet in one bucket.

* First the minimisers alone are counted. Only minimisers that more than one document has can
  bring copies together; a bitmap of 2**28 bits of them (32 MB, whatever the input) tells tasks
  which super-k-mers to send. A collision in the bitmap only sends more.
* Minimisers with very many super-k-mers (at most ``HOT_LIST`` of them) are split: there each window travels to a bucket of its own, as its fingerprint.
* A task combines equal packed strings first: it sends the copy of the smallest document, and knows
  at once that the other copies are covered. So a bucket gets a string once per task and flush.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import discard, free, map_rows, mix64, place, stored, tidy, utf8_column
from thicket.llm.words import WordHashes, grams

BITS = 28
HOT_LIST = 1_000_000
HOT_LEAST = 1_000
FLUSH = 24_000_000  # bytes of packed strings that a task combines at a time
TOGETHER = 4_000  # packed strings of whole buckets that are sorted in one go
SENT = "bucket long, doc_id long, tie long, start int, n int, packed binary"
SPANS = "doc_id long, tie long, start int, n int"
M = 8


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in linear time (prefix and suffix minima of blocks)."""
    n = len(x) - width + 1
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def super_kmers(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of a text's word hashes."""
    if len(h) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    low = sliding_min(mix64(grams(h, M)), width - M + 1)
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[start].view(np.int64), start, np.diff([*start, len(low)])


def _powers() -> tuple[np.ndarray, np.ndarray]:
    return np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64), np.array([pow(int(x), -1, 1 << 64) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], np.uint64)


def window_prints(h: np.ndarray, width: int) -> np.ndarray:
    """Two independent 64-bit fingerprints of every window (rolling polynomials over word hashes), as rows."""
    r, inverse = _powers()
    out = []
    with np.errstate(over="ignore"):
        for k in range(2):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), r[k])]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), inverse[k])]), dtype=np.uint64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(k)) * up[:-1], dtype=np.uint64)])
            out.append(mix64((total[width:] - total[:-width]) * down[: len(h) - width + 1]))
    return np.stack(out, axis=1)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _minimisers(docs: DataFrame, width: int) -> DataFrame:
    """Each minimiser with its number of super-k-mers and its smallest and largest document; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            found, docs_, ids = [], [], batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for doc_id, raw in zip(ids, utf8_column(batch.column(1)), strict=True):
                low = super_kmers(words.of(raw.split()), width)[0]
                found.append(low)
                docs_.append(np.full(len(low), doc_id))
            if not found or not (total := sum(map(len, found))):
                continue
            low, doc = np.concatenate(found), np.concatenate(docs_)
            order = np.lexsort((doc, low))
            low, doc = low[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            end = np.concatenate([first[1:], [total]])
            yield pa.record_batch([pa.array(x) for x in (low[first], end - first, doc[first], doc[end - 1])], names=["low", "n", "least", "most"])

    rows = docs.select("doc_id", "text").mapInArrow(tidy(run), "low long, n long, least long, most long")
    counted = rows.groupBy("low").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return stored(counted.where("least < most").select("low", "n"), "minimisers")


def _bitmap(repeated: DataFrame) -> np.ndarray:
    """Bits of the minimisers' low BITS bits: at most 2**BITS / 8 bytes reach the driver, in pieces of 4 KB."""
    bit = F.col("low").bitwiseAND((1 << BITS) - 1)
    pieces = repeated.groupBy(F.bitmap_bucket_number(bit + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in pieces.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def covered_spans(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tie, first word, words) spans that windows starting in a smaller document cover; stored.

    ``docs`` has doc_id (not null), tie and text. Spans of a document may overlap. ``width`` must be at least 2 * M.
    """
    if width < 2 * M:
        raise ValueError(f"windows of fewer than {2 * M} words are not supported")
    spark = docs.sparkSession
    repeated = _minimisers(docs, width)
    total = repeated.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_LEAST, total // HOT_LIST)
    hot = np.sort(np.array([r[0] for r in repeated.where(F.col("n") > least).select("low").toLocalIterator()], np.int64))
    shared = spark.sparkContext.broadcast((_bitmap(repeated), hot))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        words, waiting, size = WordHashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            # Equal strings of a bucket next to each other, the smallest document first.
            waiting.sort(key=lambda r: (r[0], r[5], r[1]))
            rows, known, before = [], [], None
            for r in waiting:
                if before is None or before[0] != r[0] or before[5] != r[5]:
                    before = r
                    rows.append(r)
                elif before[1] < r[1]:  # covered by the copy in a smaller document
                    known.append(r[1:5])
                else:
                    rows.append(r)
            # Neighbouring windows of a document that are known to be covered are one row.
            known.sort()
            merged: list[list[int]] = []
            for doc_id, tie, start, n in known:
                if merged and merged[-1][:2] == [doc_id, tie] and start <= merged[-1][2] + merged[-1][3]:
                    merged[-1][3] = max(merged[-1][3], start + n - merged[-1][2])
                else:
                    merged.append([doc_id, tie, start, n])
            spread = mix64(np.array([m[0] ^ m[2] for m in merged], np.int64).view(np.uint64)).view(np.int64).tolist()
            rows += [(to, *m, None) for to, m in zip(spread, merged, strict=True)]
            for k in range(0, len(rows), 20_000):
                yield _batch([list(c) for c in zip(*rows[k : k + 20_000], strict=True)])

        for batch in batches:
            for doc_id, tie, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_column(batch.column(2)), strict=True):
                parts = raw.split()
                if len(parts) < width:
                    continue
                h = words.of(parts)
                low, start, n = super_kmers(h, width)
                at = low & ((1 << BITS) - 1)
                keep = (bits[at >> 3] >> (at & 7)) & 1 == 1
                if not keep.any():
                    continue
                prints = None
                i = np.minimum(np.searchsorted(hot, low), max(len(hot) - 1, 0))
                split = (hot[i] == low) if len(hot) else np.zeros(len(low), bool)
                for bucket, s, k, apart in zip(low[keep].tolist(), start[keep].tolist(), n[keep].tolist(), split[keep].tolist(), strict=True):
                    if apart:
                        if prints is None:
                            prints = window_prints(h, width)
                        for w in range(s, s + k):
                            waiting.append((int(prints[w, 0].view(np.int64)), doc_id, tie, w, 1, prints[w].tobytes()))
                        size += 200 * k
                    else:
                        packed = b" ".join(parts[s : s + k + width - 1])
                        waiting.append((bucket, doc_id, tie, s, k, packed))
                        size += len(packed) + 200
                if size >= FLUSH:
                    yield from flush()
                    waiting, size = [], 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, last = WordHashes(), [], None

        def settle(rows: list[tuple]) -> Iterator[tuple]:
            """Spans covered in some whole buckets: all their windows are sorted, equal ones meet."""
            if len(rows) < 2:
                return
            n = np.array([k for _, _, _, k, _ in rows])
            which, at = np.repeat(np.arange(len(rows)), n), np.concatenate([[0], np.cumsum(n)])
            alone = np.array([len(p) == 16 for *_, p in rows])  # a window's fingerprint; 50 words are longer
            prints = np.zeros((at[-1], 2), np.uint64)
            if alone.any():
                prints[alone[which]] = np.frombuffer(b"".join(p for *_, p in rows if len(p) == 16), np.uint64).reshape(-1, 2)
            if not alone.all():
                h = words.of(b" ".join(p for *_, p in rows if len(p) != 16).split())
                size = n[~alone]
                start = np.concatenate([[0], np.cumsum(size + width - 1)])[:-1]
                own = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
                prints[~alone[which]] = window_prints(h, width)[own]
            doc = np.array([d for d, *_ in rows], np.int64)[which]
            order = np.lexsort((doc, prints[:, 1], prints[:, 0]))
            p, d = prints[order], doc[order]
            first = np.concatenate([[True], (p[1:] != p[:-1]).any(axis=1)])
            covered = np.zeros(len(order), bool)
            covered[order] = d > d[first][np.cumsum(first) - 1]
            for r in np.unique(which[covered]):
                d, tie, s, _, _ = rows[r]
                for x, m in zip(*_runs(covered[at[r] : at[r + 1]]), strict=True):
                    yield d, tie, s + int(x), int(m) + width - 1

        for batch in batches:
            out: list[tuple] = []
            for bucket, doc_id, tie, start, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packed is None:
                    out.append((doc_id, tie, start, n + width - 1))
                    continue
                if bucket != last and len(held) >= TOGETHER:
                    out += settle(held)
                    held = []
                last = bucket
                held.append((doc_id, tie, start, n, packed))
            if out:
                yield _spans(out)
        if out := list(settle(held)):
            yield _spans(out)

    sent = docs.select("doc_id", "tie", "text").mapInArrow(tidy(send), SENT)
    found = stored(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), SPANS), "spans")
    shared.destroy()
    discard(repeated)
    return found


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["bucket", "doc_id", "tie", "start", "n", "packed"])


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "tie", "start", "n"])


def _joined_spans(docs: DataFrame, width: int) -> DataFrame:
    docs = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    spans = covered_spans(docs.where("doc_id is not null"), width)
    # A document has no more spans than words.
    gathered = stored(spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "document-spans")
    discard(spans)
    return gathered


def _kept(parts: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return parts
    edge = np.zeros(len(parts) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[min(s["start"] + s["n"], len(parts))] -= 1
    return [w for w, drop in zip(parts, (np.cumsum(edge)[:-1] > 0).tolist(), strict=True) if not drop]


def deduplicated(docs: DataFrame, width: int) -> DataFrame:
    """Removes each word that is covered by a window of ``width`` words whose word sequence also starts
    in a document with a smaller ``doc_id``. Windows are judged on the input, not on what is left.

    One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words
    joined by one space) and ``kept``, that text. A null text has no words. Rows without ``doc_id`` lose no
    word and count as no earlier document. Rows that repeat a ``doc_id`` don't count as earlier for each other.
    Fewer than ``width`` words: nothing to remove. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha, kept = [], [], [], []
            for raw, spans in zip(utf8_column(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                parts = raw.split()
                left = _kept(parts, spans)
                text = b" ".join(left)
                n.append(len(parts))
                removed.append(len(parts) - len(left))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return _with_spans(docs.select("doc_id", "text"), width)[0].mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def _with_spans(docs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """``docs`` with the spans of each row in one more column, and that column's name."""
    gathered = _joined_spans(docs, width)
    tie, key, spans = (free(docs, c) for c in ("tie", "key", "spans"))
    keyed = docs.select("*", F.xxhash64("text").alias(tie), F.col("doc_id").cast("long").alias(key))
    found = gathered.select(F.col("doc_id").alias(key), F.col("tie").alias(tie), F.col("spans").alias(spans))
    return keyed.join(found, [key, tie], "left").select(*(F.col(f"`{c}`") for c in (*docs.columns, spans))), spans


def without_repeats(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with the same columns, its texts cut as in ``deduplicated`` and ``n_chars`` set anew.

    A text that loses nothing stays as it is, white space included. A text that loses all its words is
    a copy of earlier passages; its row stays, with an empty text. The text column is the one that Spark finds as ``text``.
    """
    i = place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(i).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                texts.append(b" ".join(_kept(text.encode().split(), spans)).decode() if spans else text)
            columns = list(batch.columns[:-1])
            columns[i] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=batch.schema.names[:-1])

    cut = map_rows(_with_spans(docs, width)[0], tidy(run), len(docs.columns))
    if "n_chars" not in (c.lower() for c in docs.columns):
        return cut
    n = place(docs, "n_chars")
    return cut.select(*(F.length("text").cast(docs.schema[n].dataType).alias(c) if k == n else F.col(f"`{c}`") for k, c in enumerate(docs.columns)))


