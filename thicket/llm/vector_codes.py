"""Vector code compression: product codes by Lloyd's rounds with Hamerly's bounds, in integers.

A vector's components become integers and are cut into parts; each part position has a codebook of at most 256
entries. For every part a code, one upper bound of the distance to its entry and one lower bound of the distance to
the second nearest entry are persisted between rounds, next to the vectors, so that a round is one pass without a
shuffle. When entries move, the bounds move with them. Only where the upper bound isn't strictly below the lower one
(or below half the gap around the entry) is the true distance taken, and only where that fails too are all entries scanned.
Bounds are integers, rounded so that they stay bounds: a part that is skipped is strictly nearest to its entry, and the
scan takes the lowest index of equal distances, so results are those of plain Lloyd rounds.

Sums per entry are made in the same pass and added up over tasks by entry. What reaches the driver is the codebooks: 256
times the components of a vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import discard, stored

PARTS = 4
ENTRIES = 256
SCALE = 1024
FAR = 1 << 62  # no second entry
EXACT = 1 << 52  # integers below it are exact as doubles
BLOCK_BYTES = 4 << 20  # of a block's integers in a task
STATE = "ids array<long>, labels array<string>, kind string, parts binary, codes binary, upper binary, lower binary, entry int, n long, sums binary"
CODED = "vec_id long, label string, code string, error long, scanned long"


def floor_root(x: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down, of integers below 2^62."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def ceil_root(x: np.ndarray) -> np.ndarray:
    r = floor_root(x)
    return r + (r * r < x)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries; by a product of doubles where all integers are small enough to be exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 4 * x.shape[1] * most * most < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for k, e in enumerate(entries):
        out[:, k] = ((x - e) ** 2).sum(axis=1)
    return out


@dataclass
class Codebooks:
    """Entries (part, entry, position), the gaps around them and how far the last update moved them."""

    entries: np.ndarray
    gap: np.ndarray  # at most the distance to the nearest other entry
    drift: np.ndarray  # at least the distance moved
    others: np.ndarray  # at least what any other entry moved

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None = None) -> Codebooks:
        parts, k, _ = entries.shape
        gap, drift = np.full((parts, k), FAR, np.int64), np.zeros((parts, k), np.int64)
        others = np.zeros((parts, k), np.int64)
        for p in range(parts):
            if k > 1:
                apart = distances(entries[p], entries[p])
                np.fill_diagonal(apart, FAR)
                gap[p] = floor_root(apart.min(axis=1))
            if before is not None:
                drift[p] = ceil_root(((entries[p] - before[p]) ** 2).sum(axis=1))
                order = np.argsort(drift[p])
                others[p] = drift[p][order[-1]]
                others[p][order[-1]] = drift[p][order[-2]] if k > 1 else 0
        return Codebooks(entries, gap, drift, others)

    def updated(self, counts: np.ndarray, sums: np.ndarray) -> Codebooks:
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        return Codebooks.of(entries, self.entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


@dataclass
class Assigned:
    """Of a block: per row and part the code, the bounds, and how many parts were scanned."""

    codes: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: np.ndarray

    @staticmethod
    def unknown(rows: int) -> Assigned:
        """Before the first round: bounds that fail."""
        shape = (rows, PARTS)
        return Assigned(np.zeros(shape, np.uint8), np.full(shape, FAR, np.int64), np.zeros(shape, np.int64), np.zeros(rows, np.int64))

    def moved(self, x: np.ndarray, books: Codebooks) -> Assigned:
        """The assignment of the rows ``x`` (row, part, position) after the entries have moved."""
        codes, scanned = self.codes.copy(), np.zeros(len(x), np.int64)
        upper, lower = np.empty_like(self.upper), np.empty_like(self.lower)
        for p in range(PARTS):
            at = codes[:, p].astype(np.int64)
            u = np.minimum(self.upper[:, p], FAR - books.drift[p][at]) + books.drift[p][at]
            low = np.maximum(self.lower[:, p] - books.others[p][at], 0)
            gap = books.gap[p][at]
            open_ = np.flatnonzero(~((u < low) | (2.0 * u < gap)))
            if len(open_):
                own = ceil_root(((x[open_, p] - books.entries[p][at[open_]]) ** 2).sum(axis=1))
                u[open_] = own
                open_ = open_[~((own < low[open_]) | (2 * own < gap[open_]))]
            for k in range(0, len(open_), 2048):
                rows = open_[k : k + 2048]
                apart = distances(x[rows, p], books.entries[p])
                nearest = apart.argmin(axis=1)  # the lowest of equal ones
                here = np.arange(len(rows))
                u[rows] = ceil_root(apart[here, nearest])
                apart[here, nearest] = FAR
                second = apart.min(axis=1)
                low[rows] = np.where(second < FAR, floor_root(np.minimum(second, FAR - 1)), FAR)
                codes[rows, p] = nearest
                scanned[rows] += 1
            upper[:, p], lower[:, p] = u, low
        return Assigned(codes, upper, lower, scanned)

    def errors(self, x: np.ndarray, books: Codebooks) -> np.ndarray:
        near = np.stack([books.entries[p][self.codes[:, p]] for p in range(PARTS)], axis=1)
        return ((x - near) ** 2).sum(axis=(1, 2))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of a column of vectors without nulls, filled up with zeros to ``width``, cut at what squares can hold."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    most = float(limit(width))
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64)
    if len(flat) == len(column) * width and (np.diff(ends) == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for i in range(len(column)):
        own = flat[ends[i] : ends[i + 1]]
        out[i, : len(own)] = own
    return out


def limit(width: int) -> int:
    """Largest integer of a component: the squared distance of two vectors then is below 2^62."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2 - 1


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


class Sums:
    """Counts and sums of the parts of a task by entry."""

    def __init__(self, books: Codebooks):
        self.counts, self.sums = np.zeros(books.entries.shape[:2], np.int64), np.zeros(books.entries.shape, np.int64)

    def add(self, x: np.ndarray, codes: np.ndarray) -> None:
        for p in range(PARTS):
            self.counts[p] += np.bincount(codes[:, p], minlength=self.counts.shape[1])
            np.add.at(self.sums[p], codes[:, p], x[:, p])

    def rows(self) -> Iterator[pa.RecordBatch]:
        used = np.argwhere(self.counts > 0)
        if len(used):
            entry = [p * self.counts.shape[1] + k for p, k in used.tolist()]
            packed = [self.sums[p, k].astype("<i8").tobytes() for p, k in used.tolist()]
            yield _state(len(used), entry=pa.array(entry, pa.int32()), n=pa.array(self.counts[self.counts > 0]), sums=pa.array(packed, pa.binary()))


_TYPES = {"ids": pa.list_(pa.int64()), "labels": pa.list_(pa.string()), "kind": pa.string(), "parts": pa.binary(), "codes": pa.binary(), "upper": pa.binary(), "lower": pa.binary(), "entry": pa.int32(), "n": pa.int64(), "sums": pa.binary()}


def _state(rows: int, **given: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([given.get(name, pa.nulls(rows, kind)) for name, kind in _TYPES.items()], names=list(_TYPES))


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, found: Assigned) -> pa.RecordBatch:
    kind, parts = _packed(x)
    small = lambda a: pa.array([a.astype("<i8").tobytes()], pa.binary())
    return _state(1, ids=pa.array([ids.to_pylist()], pa.list_(pa.int64())), labels=pa.array([labels.to_pylist()], pa.list_(pa.string())), kind=pa.array([kind]), parts=pa.array([parts], pa.binary()), codes=pa.array([found.codes.tobytes()], pa.binary()), upper=small(found.upper), lower=small(found.lower))


def _unpacked(kind: str, parts: bytes, codes: bytes, upper: bytes, lower: bytes) -> tuple[np.ndarray, Assigned]:
    codes = np.frombuffer(codes, np.uint8).reshape(-1, PARTS)
    bound = lambda raw: np.frombuffer(raw, "<i8").reshape(-1, PARTS).astype(np.int64)
    x = np.frombuffer(parts, kind).astype(np.int64).reshape(len(codes), PARTS, -1)
    return x, Assigned(codes, bound(upper), bound(lower), np.zeros(len(codes), np.int64))


def _first_round(kept: DataFrame, width: int, books: Codebooks) -> DataFrame:
    """Blocks of integers with codes and bounds, and each task's sums; stored."""
    several = max(1, BLOCK_BYTES // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(books)
        for batch in batches:
            for at in range(0, batch.num_rows, several):
                part = batch.slice(at, several)
                x = integers(part.column(2), width).reshape(part.num_rows, PARTS, width // PARTS)
                found = Assigned.unknown(len(x)).moved(x, books)
                sums.add(x, found.codes)
                yield _block(part.column(0), part.column(1), x, found)
        yield from sums.rows()

    return stored(kept.mapInArrow(run, STATE), "code-state")


def _blocks(state: DataFrame) -> DataFrame:
    return state.where("parts is not null").select("ids", "labels", "kind", "parts", "codes", "upper", "lower")


def _next_round(state: DataFrame, books: Codebooks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(books)
        for batch in batches:
            for i in range(batch.num_rows):
                x, before = _unpacked(*(batch.column(k)[i].as_py() for k in range(2, 7)))
                found = before.moved(x, books)
                sums.add(x, found.codes)
                yield _block(batch.column(0)[i].values, batch.column(1)[i].values, x, found)
        yield from sums.rows()

    return stored(_blocks(state).mapInArrow(run, STATE), "code-state")


def _last_round(state: DataFrame, books: Codebooks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, before = _unpacked(*(batch.column(k)[i].as_py() for k in range(2, 7)))
                found = before.moved(x, books)
                code = [c.tobytes().hex() for c in found.codes]
                yield pa.record_batch([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code, pa.string()), pa.array(found.errors(x, books)), pa.array(found.scanned)], names=["vec_id", "label", "code", "error", "scanned"])

    return stored(_blocks(state).mapInArrow(run, CODED), "codes")


def _updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """Adds up the tasks' sums by entry, each entry in one task; at most 4 * 256 rows reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for entry, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[entry] = counts.get(entry, 0) + n
                sums[entry] = sums.get(entry, 0) + np.frombuffer(raw, "<i8")
        yield pa.record_batch([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([sums[e].astype("<i8").tobytes() for e in counts], pa.binary())], names=["entry", "n", "sums"])

    parts = state.where("entry is not null").select("entry", "n", "sums")
    total = parts.repartition("entry").mapInArrow(add, "entry int, n long, sums binary")
    shape = books.entries.shape
    counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for r in total.collect():
        counts[divmod(r.entry, shape[1])] = r.n
        sums[divmod(r.entry, shape[1])] = np.frombuffer(r.sums, "<i8")
    return books.updated(counts, sums)


def vector_codes(embeddings: DataFrame, rounds: int = 4) -> DataFrame:
    """Codes of vectors: one row per kept row of ``embeddings``.

    ``vec_id``, ``code`` (an entry's index in two hex digits for each of four parts), ``error`` (squared distances of the parts to
    their entries), ``label_error`` (sum over equal labels, nulls together), ``codebooks_sha256`` and ``scanned`` (parts whose
    bounds failed in the last assignment, of four). Rows whose vector is null or holds null or non-finite components are
    dropped. Codebooks start as the parts of the 256 smallest rows by ``vec_id`` and vector that have a ``vec_id`` (of all rows if none
    has one; fewer rows: fewer entries). Rows without ``vec_id``, and rows that repeat one, are coded like others. Vectors are
    filled up with zeros to the length of the longest, and that to a multiple of four (at least four). Components count as at most
    ``limit`` in size (2^27 / 1024 for 64 components), so that squared distances stay within a long. ``label`` may have any type
    that casts to a string; other columns are not read. An empty table gives no rows.
    """
    x = F.col("vector")
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = kept.where(x.isNotNull() & ~odd)
    longest = kept.agg(F.max(F.size(x))).first()[0] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), x).limit(ENTRIES).collect()
    first = [r for r in first if r.vec_id is not None] or first
    start = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width)
    books = Codebooks.of(np.ascontiguousarray(start.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)))
    if not first:
        return _answer(embeddings.sparkSession.createDataFrame([], CODED), books)
    state = _first_round(kept, width, books)
    for k in range(rounds):
        books = _updated(state, books)
        if k + 1 < rounds:
            last, state = state, _next_round(state, books)
            discard(last)
    codes = _last_round(state, books)
    discard(state)
    return _answer(codes, books)


def _answer(codes: DataFrame, books: Codebooks) -> DataFrame:
    """A label may hold most rows: its sum is one row of a join, whose other side adaptive execution splits."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    own = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label")).alias("key")
    joined = codes.withColumn("key", own).join(sums.select(own, "label_error"), "key")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), "scanned")
