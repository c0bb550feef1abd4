"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from thicket.sources.store import discard, shared_folder, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder of the session (``sources.store`` has the rule for a session without one)."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Bytes of rows after which Spark closes an Arrow batch for Python, and what ``small_batches`` sets it to.
BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python hold a few MB, unless it has set their size itself.

    Spark's 64 MB or 10,000 rows of texts are held outside of the heap for each task, on the way to Python and back, and several times
    over in the worker; over many stages, executors keep most of the memory that such a peak once took.
    """
    if not spark.conf.get(BATCH_BYTES, None):
        spark.conf.set(BATCH_BYTES, str(SMALL_BATCH))


class Memo:
    """A memo bounded by bytes, in two generations: when the young one is full it becomes the old one, from which what is used again moves up.

    Plain dictionaries, as sets are subtracted from these key by key and from subclasses as a whole.
    """

    ENTRY = 180  # bytes of a dictionary's entry and the two objects' headers

    def __init__(self, room: int = 96 << 20):
        self.young, self.old, self.used, self.half = {}, {}, 0, room // 2

    def missing(self, keys: set) -> set:
        """The keys that aren't known; the others can be read from ``young`` until the next call."""
        if self.used > self.half:
            self.old, self.young, self.used = self.young, {}, 0
        new = keys.difference(self.young)
        unknown = new.difference(self.old)
        if len(unknown) < len(new):
            old, again = self.old, new.difference(unknown)
            self.young.update({k: old[k] for k in again})
            self.used += self.ENTRY * len(again) + sum(map(len, again))
        return unknown

    def put(self, found: dict, size: int) -> None:
        """``size``: bytes of the keys and values."""
        self.young.update(found)
        self.used += size + self.ENTRY * len(found)

    def forget(self, keys: Iterable) -> None:
        for k in keys:
            self.young.pop(k, None)


#: What operators keep in a worker process between tasks: by owner, a function that frees it.
KEPT: dict[str, Callable[[], None]] = {}


def claim(owner: str) -> None:
    """A task's call at its start: frees what other operators keep in this worker process, which may serve many of them in turn,
    and gives free memory back to the system, where allocators would hold it."""
    for name, clear in KEPT.items():
        if name != owner:
            clear()
    give_back()


def give_back() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker gives free memory back when a task ends: a worker that then waits for another task, while
    stages without Python run, holds no more than it keeps on purpose."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


#: Keys beyond so many characters are not kept in memos.
LONG = 128


def place(df: DataFrame, name: str) -> int:
    """The position of the column that Spark resolves ``name`` to: letter case counts only where the session says so."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        found = [i for i, c in enumerate(df.columns) if c == name]
    else:
        found = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns named {name}")
    return found[0]


def map_rows(df: DataFrame, run, columns: int | None = None) -> DataFrame:
    """``mapInArrow`` that keeps the (first ``columns``) columns of ``df``, whatever their names hold (Spark's own doesn't take dots)."""
    kept = df.columns if columns is None else df.columns[:columns]
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields[: len(kept)])])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema).toDF(*kept)


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_column(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes, without decoding; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def utf8_values(column: pa.Array) -> Iterator[bytes]:
    """``utf8_column`` one value at a time, so that a batch isn't held twice."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (x.as_py() or b"" for x in column.cast(kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit lanes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flag_count(df: DataFrame, condition) -> int:
    """How many rows meet the condition (one number reaches the driver)."""
    return df.agg(F.count(F.when(condition, 1))).first()[0]
