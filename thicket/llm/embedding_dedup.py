"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

In each of several tables a vector's code is the signs of its products with random hyperplanes. Vectors
with one label and one code in a table are compared by exact cosine in double precision. The number of
bits follows the number of vectors, so that unrelated vectors seldom share a code, and the number of
tables follows from the bits, so that a pair at the threshold meets with the probability ``recall``.

Equal vectors are one class and stand once. First only codes travel; vectors follow for codes that more
than one class has. Codes of more than ``BLOCK`` classes are compared block by block, each pair of blocks
as a group of its own, by matrix products; only numbers of links and a spanning forest leave a group, never
its pairs. A pair counts in the first table in which it meets, so no pair counts twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import mix64, stored
from thicket.llm.components import connected_components

BLOCK = 1024
PAIRS = 10_000  # close pairs whose codes are compared at a time
VECTORS = "vec_id long, label long, vec binary"
CODES = "node long, code long, tab int"
LINKS = "node long, n long, other long"


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a code, and tables, for ``n`` vectors."""
    bits = min(40, max(10, math.ceil(math.log2(max(n, 2))) - 3))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


@lru_cache(maxsize=8)
def _planes(width: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, number))


def codes(x: np.ndarray, bits: int, tables: int, seed: int, first: int | None = None) -> np.ndarray:
    """Codes of the rows of ``x``, a column for each table (of the ``first`` ones only, if given)."""
    planes, powers = _planes(x.shape[1], bits * tables, seed), 1 << np.arange(bits, dtype=np.int64)
    used = tables if first is None else first
    out = np.empty((len(x), used), np.int64)
    for k in range(0, len(x), 1024):
        part = x[k : k + 1024]
        out[k : k + 1024] = (part @ planes[:, : used * bits] > 0).reshape(len(part), used, bits) @ powers
    return out


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_size(raw: list[bytes]) -> Iterator[np.ndarray]:
    """Positions of vectors of one length each: others can't be compared."""
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """The rows that can link (label and every component given, finite, not all zero), components as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, raw = batch.column(2), []
            flat, ends = column.values, column.offsets.to_numpy()
            null = flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8")
            good = np.isfinite(x) & ~null
            for i, there in enumerate(column.is_valid().to_pylist()):
                own = slice(ends[i], ends[i + 1])
                raw.append((x[own] + 0.0).tobytes() if there and good[own].all() and x[own].any() else None)
            keep = pa.array([r is not None for r in raw], pa.bool_())
            yield pa.record_batch([batch.column(0).cast(pa.int64()).filter(keep), batch.column(1).cast(pa.int64()).filter(keep), pa.array(raw, pa.binary()).filter(keep)], names=["vec_id", "label", "vec"])

    return embeddings.where("vec_id is not null and label is not null and embedding is not null").select("vec_id", "label", "embedding").mapInArrow(run, VECTORS)


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` positions the first one of its component; ``near`` links ``left`` (rows) with ``right`` (columns)."""
    root, todo = np.arange(n), {True: near.any(axis=1), False: near.any(axis=0)}
    back, sides = np.ascontiguousarray(near.T), {True: left, False: right}
    for start in np.flatnonzero(todo[True]).tolist():
        if not todo[True][start]:
            continue
        todo[True][start] = False
        found, waiting = [left[start]], [(True, start)]
        while waiting:
            side, i = waiting.pop()
            new = np.flatnonzero((near[i] if side else back[i]) & todo[not side])
            todo[not side][new] = False
            found += sides[not side][new].tolist()
            waiting += [(not side, j) for j in new.tolist()]
        root[found] = min(found)
    return root


def _compare(rows: list[tuple], threshold: float, bits: int, tables: int, seed: int) -> Iterator[tuple]:
    """Links in one group: (node, links counted here, a node it hangs on in the forest or null).

    Two blocks of at most some ``BLOCK`` rows: a square of bytes, the vectors, and codes of slices of pairs are all that is held.
    """
    first_block, second_block, tab = rows[0][1], rows[0][2], rows[0][7]
    for at in _by_size([r[6] for r in rows]):
        part = [rows[i] for i in at]
        x = _unit([r[6] for r in part])
        node, copies, block = (np.array([r[k] for r in part]) for k in (4, 5, 3))
        left, right = np.flatnonzero(block == first_block), np.flatnonzero(block == second_block)
        near = np.zeros((len(left), len(right)), bool)
        for k in range(0, len(left), 256):
            a = left[k : k + 256]
            near[k : k + 256] = (x[a] @ x[right].T >= threshold) & (a[:, None] != right[None, :])
        if not near.any():
            continue
        counted, code = np.zeros(len(part), np.int64), codes(x, bits, tables, seed, first=tab)
        i, j = np.nonzero(near)
        for s in range(0, len(i), PAIRS):
            p, q = left[i[s : s + PAIRS]], right[j[s : s + PAIRS]]
            new = ~(code[p] == code[q]).any(axis=1)  # no earlier table brought them together
            np.add.at(counted, p[new], copies[q[new]])
            if first_block != second_block:
                np.add.at(counted, q[new], copies[p[new]])
        root = _forest(near, left, right, len(part)) if first_block != second_block else _forest(near, left, left, len(part))
        for i in np.flatnonzero((counted > 0) | (root != np.arange(len(part)))):
            yield int(node[i]), int(counted[i]), int(node[root[i]]) if root[i] != i else None


def near_duplicates(embeddings: DataFrame, threshold: float, recall: float = 0.995, seed: int = 11) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``threshold``, and their components.

    One row per row of ``embeddings`` (``vec_id``, ``embedding``, ``label``; other columns are not read): ``vec_id``,
    ``n_links`` (other rows linked directly), ``component_id`` (smallest ``vec_id`` reachable, itself included) and
    ``kept`` (``vec_id = component_id``). Rows without ``vec_id`` or label, and vectors that are null, zero or have null
    or non-finite components, link with nothing and are their own component (a null ``vec_id``: kept, null component).
    Vectors of different lengths don't link. Rows that repeat a ``vec_id`` are vectors like others. Equal vectors always
    link; other pairs at the threshold are found with the probability ``recall``, closer ones with a higher one, and no
    pair below it links.
    """
    valid = stored(valid_vectors(embeddings).withColumn("node", F.xxhash64("label", "vec")), "vectors")
    classes = stored(valid.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vec").alias("vec")), "vector-classes")
    bits, tables = plan_tables(classes.count(), threshold, recall)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, raw = (batch.column(i) for i in range(3))
            node, label, raw = node.to_numpy(zero_copy_only=False), label.to_numpy(zero_copy_only=False), raw.to_pylist()
            for at in _by_size(raw):
                code = codes(_unit([raw[i] for i in at]), bits, tables, seed)
                with np.errstate(over="ignore"):
                    place = mix64(label[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(raw[at[0]])))[:, None] + np.arange(tables, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
                    key = mix64(mix64(place) + code.astype(np.uint64)).view(np.int64)
                tab = np.broadcast_to(np.arange(tables, dtype=np.int32), code.shape)
                yield pa.record_batch([pa.array(np.repeat(node[at], tables)), pa.array(key.ravel()), pa.array(tab.ravel())], names=["node", "code", "tab"])

    coded = stored(classes.select("node", "label", "vec").mapInArrow(encode, CODES), "codes")
    shared = stored(coded.groupBy("code").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m"), "shared-codes")
    members = coded.join(shared, "code").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("node", "code", "tab", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    members = stored(members, "code-members").join(classes.select("node", "copies", "vec"), "node")
    groups = members.repartition("code", "i", "j").sortWithinPartitions("code", "i", "j").select("code", "i", "j", "block", "node", "copies", "vec", "tab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["node", "n", "other"])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    if len(held) > 1:
                        out += _compare(held, threshold, bits, tables, seed)
                    held = []
                held.append(row)
            if out:
                yield rows(out)
        if len(held) > 1 and (out := list(_compare(held, threshold, bits, tables, seed))):
            yield rows(out)

    links = stored(groups.mapInArrow(compare, LINKS), "vector-links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    found = connected_components(links.where("other is not null").select("node", "other"))
    of = classes.select("node", "copies", "least").join(counts, "node", "left").join(found.withColumnRenamed("id", "node"), "node", "left")
    of = stored(of.select("node", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "class-components")
    least = stored(of.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    of = stored(of.join(least, "component").select("node", "n_links", "component_id"), "class-labels")
    linked = valid.select("vec_id", "node").join(of, "node").select("vec_id", "n_links", "component_id")
    alone = _invalid(embeddings).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _invalid(embeddings: DataFrame) -> DataFrame:
    """The complement of ``valid_vectors``, by the same conditions."""
    e = F.col("embedding")
    number = F.transform(e, lambda v: v.cast("double"))
    bad = F.exists(number, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists(number, lambda v: F.coalesce(v != 0, F.lit(False)))
    none = F.col("vec_id").isNull() | F.col("label").isNull() | e.isNull()
    return embeddings.where(none | F.coalesce(bad, F.lit(True)) | F.coalesce(zero, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"))
