"""Token ids as binary shards with a minimal perfect hash index.

A shard holds the ids of a range of documents, in ascending ``doc_id`` order::

    id payload | index levels | slots | document order | sizes

The index is a minimal perfect hash: level by level, keys hash to twice as many
bits as there are keys left, keys alone on their bit stay there, the others go on.
A key's slot is the rank of its bit, so the index needs a few bits a key and a
look-up is constant work. The slot stores the key's 64-bit fingerprint (which
tells foreign keys apart), and its ids' offset and number. Rows with equal
``doc_id`` are distinct keys: the key is (``doc_id``, occurrence in the shard).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.bpe import SLICE, encoder
from thicket.llm.common import mix64, scratch, stored

MAGIC = b"TKSHARD1"
SIZES, SIZES_SIZE = "<8sQQQI4x", 40  # magic, documents, ids, bytes of the index levels, bytes of an id
LEVELS = 48
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long, nulls long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def keys_of(doc_ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = mix64(doc_ids.astype(np.uint64) ^ (nulls.astype(np.uint64) << np.uint64(63))) + nulls.astype(np.uint64)
        return mix64(key + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys + np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64)))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # (64-bit words, rank before each word); keys that no level placed

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, base = [], 0
        for level in range(LEVELS):
            if not len(keys):
                break
            n_words = len(keys) // 32 + 1
            at = (_hash(keys, level) % np.uint64(64 * n_words)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * n_words) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            rank = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            levels.append((words, rank[:-1].astype("<u4")))
            base, keys = int(rank[-1]), keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for a key that was not built in."""
        out, todo, placed = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, (words, rank) in enumerate(self.levels):
            at = _hash(keys[todo], level) % np.uint64(64 * len(words))
            word, bit = words[at >> np.uint64(6)], at & np.uint64(63)
            here = (word >> bit) & np.uint64(1) == 1
            below = word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[todo[here]] = rank[(at >> np.uint64(6))[here].astype(np.int64)].astype(np.int64) + np.bitwise_count(below)
            todo = todo[~here]
            placed = int(rank[-1]) + int(np.bitwise_count(words[-1]))
        if len(self.rest) and len(todo):
            i = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[i] == keys[todo]
            out[todo[hit]] = placed + i[hit]
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<II", len(self.levels), len(self.rest))]
        for words, rank in self.levels:
            parts += [struct.pack("<Q", len(words)), words.tobytes(), rank.tobytes()]
        return b"".join([*parts, self.rest.astype("<u8").tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        (n, rest), at, levels = struct.unpack_from("<II", raw), 8, []
        for _ in range(n):
            (w,) = struct.unpack_from("<Q", raw, at)
            levels.append((np.frombuffer(raw, "<u8", w, at + 8), np.frombuffer(raw, "<u4", w, at + 8 + 8 * w)))
            at += 8 + 12 * w
        return cls(levels, np.frombuffer(raw, "<u8", rest, at))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _occurrences(ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """How many equal ids stand before each (equal ones are adjacent)."""
    if not len(ids):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])])
    first = np.flatnonzero(new)
    return np.arange(len(ids)) - np.repeat(first, np.diff([*first, len(ids)]))


class Shard:
    """Reads one shard file: in document order, or by key."""

    def __init__(self, path: str):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        sizes = self.file.read_at(SIZES_SIZE, size - SIZES_SIZE) if size >= SIZES_SIZE else bytes(SIZES_SIZE)
        magic, self.n, self.n_ids, levels, self.width = struct.unpack(SIZES, sizes)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        at = self.n_ids * self.width
        self.index = PerfectHash.load(self.file.read_at(levels, at))
        slots = np.frombuffer(self.file.read_at(24 * self.n, at + levels), "<u8").reshape(3, self.n)
        self.fingerprint, self.offset, self.length = slots
        order = self.file.read_at(9 * self.n, at + levels + 24 * self.n)
        self.doc_ids = np.frombuffer(order, "<i8", self.n)
        self.nulls = np.frombuffer(order, bool, self.n, 8 * self.n)

    def find(self, doc_ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that are not here."""
        keys = keys_of(doc_ids, nulls, occurrence)
        slot = self.index.slots(keys)
        slot[(slot >= 0) & (self.fingerprint[np.maximum(slot, 0)] != mix64(~keys))] = -1
        return slot

    def ids(self, slot: int) -> np.ndarray:
        n, at = int(self.length[slot]), int(self.offset[slot])
        return np.frombuffer(self.file.read_at(n * self.width, at * self.width), f"<u{self.width}").astype("<u4")

    def documents(self) -> Iterator[tuple[int, bool, int, np.ndarray]]:
        """doc_id, whether it is null, offset and ids of each document in order, each looked up by its key."""
        slots = self.find(self.doc_ids, self.nulls, _occurrences(self.doc_ids, self.nulls))
        if (slots < 0).any():
            raise ValueError("a document of the shard is missing in its index")
        for doc_id, null, slot in zip(self.doc_ids.tolist(), self.nulls.tolist(), slots.tolist(), strict=True):
            yield doc_id, null, int(self.offset[slot]), self.ids(slot)


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes whole texts (null: empty), appends ``end_id``, and writes shards below ``folder``.

    Texts are range-partitioned and sorted by ``doc_id`` (nulls first; ties by a hash of the text),
    so shard k holds the k-th range. A task streams its ids to a file of its own attempt and renames
    it when complete, so a lost executor leaves no half shard under a final name. Returns the
    manifest, one row per shard that has rows; an empty table gives an empty manifest.
    Columns of ``docs`` other than ``doc_id`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, coder = TaskContext.get(), encoder(tokenizer_file)
        end, narrow = np.array([end_id], "<u4").tobytes(), len(coder.starts) <= 1 << 16 and end_id < 1 << 16
        width, out, doc_ids, nulls, lengths = 2 if narrow else 4, None, [], [], []
        final = f"{folder}/shard-{task.partitionId():06d}.tok"
        fs, at = _open(final)
        temp = f"{at}.{task.taskAttemptId()}.part"
        for batch in batches:
            if out is None:
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(temp)
            column = batch.column(0).cast(pa.int64())
            doc_ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(column.is_null().to_numpy(zero_copy_only=False))
            for k in range(0, batch.num_rows, SLICE):
                coded = coder.encode_all([x or "" for x in batch.column(1).slice(k, SLICE).to_pylist()])
                out.write(np.frombuffer(end.join([*coded, b""]), "<u4").astype(f"<u{width}").tobytes())
                lengths += [len(raw) // 4 + 1 for raw in coded]
        if out is None:
            return
        ids, null, n = np.concatenate(doc_ids), np.concatenate(nulls), np.array(lengths, np.int64)
        keys = keys_of(ids, null, _occurrences(ids, null))
        index = PerfectHash.build(keys)
        slots, table = index.slots(keys), np.zeros((3, len(keys)), "<u8")
        table[:, slots] = [mix64(~keys), (np.cumsum(n) - n).astype(np.uint64), n.astype(np.uint64)]
        levels = index.dump()
        sizes = struct.pack(SIZES, MAGIC, len(ids), int(n.sum()), len(levels), width)
        for part in (levels, table.tobytes(), ids.astype("<i8").tobytes(), null.tobytes(), sizes):
            out.write(part)
        out.close()
        fs.move(temp, at)
        known = ids[~null]
        row = [task.partitionId(), final, len(ids), int(n.sum()), int(known.min()) if len(known) else None, int(known.max()) if len(known) else None, int(null.sum())]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["shard", "path", "n_docs", "n_ids", "first_id", "last_id", "nulls"])

    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stored(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``.

    ``start`` needs the ids before each shard, a running sum over the manifest (a row per shard,
    not per document). Each document's ids are found through the shard's index.
    """
    starts = manifest.withColumn("before", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))
    shards = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, starts, sizes, sums = [], [], [], []
                for doc_id, null, offset, ids in Shard(row["path"]).documents():
                    doc_ids.append(None if null else doc_id)
                    starts.append(row["before"] + offset)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (doc_ids, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.select("path", "before").repartition(shards).mapInArrow(run, ROWS)


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: the ids (``array<int>``) of every stored document whose ``doc_id`` is in ``keys``.

    A key goes to the shards whose range holds it (a join with the manifest), where the index gives its
    slot. Null keys, and keys that no document has, give no row; a repeated ``doc_id`` gives a row for
    each document.
    """
    wanted = keys.select("doc_id").distinct().join(manifest, F.col("doc_id").between(F.col("first_id"), F.col("last_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, shard = row["path"], Shard(row["path"])
                occurrence = 0
                while (slot := shard.find(np.array([row["doc_id"]]), np.array([False]), np.array([occurrence]))[0]) >= 0:
                    yield pa.record_batch([pa.array([row["doc_id"]], pa.int64()), pa.array([shard.ids(slot).astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    occurrence += 1

    return wanted.select("doc_id", "path").repartition("path").sortWithinPartitions("path").mapInArrow(run, "doc_id long, ids array<int>")
