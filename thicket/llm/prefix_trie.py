"""Trie of conversation prefixes by prefix doubling.

Turns get dense names. Blocks of 2, 4, 8 .. turns that start at a multiple of their length are named in rounds: a block's
name stands for the pair of names of its halves. A prefix of d turns is composed along the binary digits of d: a
prefix with one digit is a block; one with r digits is named for the pair of the prefix without its last digit and the
block that follows it. So names of all prefixes take about two rounds for each doubling of the longest conversation, and equal names
are equal prefixes. A node of the trie is a group of rows with one name.

Sums over subtrees need no walk over levels: each node belongs to its smallest member. What a member owns from a depth on is a running
sum along its conversation, and a node's subtree is what all its members own from the node's depth on.

Running sums and digests are made over ranges of rows in order, not over groups, so a conversation, or a node with a third of
all conversations, is work for many tasks. Tables hold numbers and digests of turns; texts aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from thicket.llm.common import discard, stored

GROUP = 20  # conversations that share their first turns
BORROWED = 4  # a conversation borrows fewer turns than this
CHUNK = 1 << 20  # bytes of ids in one row
EMPTY = hashlib.sha256().hexdigest()


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(rows: DataFrame, group: str, order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` (stored) with the sums of the long columns ``sums`` over the rows of their ``group`` up to each row, in order; stored.

    Rows are dealt by ranges, and a range adds what its first group had in the ranges before it. One row a range reaches the driver.
    """
    keep = rows.schema
    names = [f.name for f in keep.fields]
    at, where = [names.index(s) for s in sums], names.index(group)
    plus = StructType([*keep.fields, StructField("range", IntegerType()), StructField("last", BooleanType())])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carry, held = None, [0] * len(at), None
        part = TaskContext.get().partitionId()

        def out(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            flag = np.zeros(batch.num_rows, bool)
            flag[-1] = last
            return pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(flag)], names=plus.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(where).to_numpy(zero_copy_only=False)
            begins = np.concatenate([[now is None or key[0] != now], key[1:] != key[:-1]])
            run = np.cumsum(begins)  # 0: goes on from the batch before
            starts = np.flatnonzero(begins)
            columns = list(batch.columns)
            for j, c in enumerate(at):
                total = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
                base = np.concatenate([[-carry[j]], np.concatenate([[0], total])[starts]])
                total = total - base[run]
                columns[c], carry[j] = pa.array(total), int(total[-1])
            now = key[-1]
            if held is not None:
                yield out(held, False)
            held = pa.record_batch(columns, names=names)
        if held is not None:
            yield out(held, True)

    ranged = rows.repartitionByRange(_partitions(rows), group, *order).sortWithinPartitions(group, *order)
    ranged = stored(ranged.mapInArrow(within, plus), "ranges")
    before: dict[int, tuple[int, list[int]]] = {}  # of a range: the last group of the ranges before it, and its sums
    seen: tuple[int, list[int]] | None = None
    for r in sorted(ranged.where("last").select("range", group, *sums).collect()):
        own = list(r[2:])
        if seen:
            before[r[0]] = seen
            if seen[0] == r[1]:
                own = [x + y for x, y in zip(own, seen[1], strict=True)]
        seen = (r[1], own)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in range(len(names))]
            key, part = columns[where].to_numpy(zero_copy_only=False), batch.column(len(names)).to_numpy(zero_copy_only=False)
            for p in np.unique(part).tolist():
                found = before.get(p)
                if found:
                    same = (part == p) & (key == found[0])
                    for c, more in zip(at, found[1], strict=True):
                        columns[c] = pa.array(columns[c].to_numpy(zero_copy_only=False) + same * more)
            yield pa.record_batch(columns, names=names)

    out = stored(ranged.mapInArrow(across, keep), "running")
    discard(ranged)
    return out


class Names:
    """Dense names from 1 on, for one kind of key after another."""

    def __init__(self) -> None:
        self.used = 0

    def of(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Each distinct key with its ``name``. One row a partition reaches the driver and comes back."""
        distinct = stored(rows.select(*keys).distinct().withColumn("at", F.monotonically_increasing_id()), "names")
        part = F.shiftrightunsigned("at", 33)
        starts = []
        for r in distinct.groupBy(part.alias("part")).count().orderBy("part").collect():
            starts.append((r["part"], self.used + 1 - (r["part"] << 33)))
            self.used += r["count"]
        starts = rows.sparkSession.createDataFrame(starts, "part long, plus long")
        return distinct.join(F.broadcast(starts), part == F.col("part")).select(*keys, (F.col("at") + F.col("plus")).alias("name"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (``conv``, ``pos`` from 0, ``digest``, ``words``) of the rebuilt conversations, and their ids and lengths (``conv``, ``depth``); both stored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("words"),
        F.lit(1).cast("long").alias("pos"),
    )
    turns = stored(turns, "turns")
    numbered = running(turns, "conv", ["turn", "digest"], ["pos"])
    discard(turns)
    numbered = numbered.select("conv", (F.col("pos") - 1).alias("pos"), "digest", "words")
    sizes = stored(numbered.groupBy("conv").agg(F.count("*").alias("own")), "sizes")
    base = F.col("conv") - F.col("conv") % GROUP
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(BORROWED))
    convs = sizes.withColumn("base", base).withColumn("h", taken).join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("depth")), "rebuilt-sizes")
    first = numbered.where(F.col("pos") < BORROWED - 1).withColumnRenamed("conv", "base")
    borrowed = convs.join(first, "base").where("pos < h").select("conv", "pos", "digest", "words")
    own = numbered.join(convs.select("conv", "h", "k"), "conv").where("pos >= h").select("conv", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "digest", "words")
    return stored(borrowed.union(own), "rebuilt"), convs.select("conv", "depth")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv``, ``depth`` and ``name`` of every prefix, the empty one with name 0; stored."""
    longest = convs.agg(F.max("depth")).first()[0] or 0
    names, own = Names(), {}
    if longest:
        level = turns.join(names.of(turns, ["digest"]), "digest").select("conv", "pos", "name")
        own[0] = stored(level, "blocks")
    k = 0
    while 2 << k <= longest:
        half = 1 << k
        place = F.col("pos") % (2 * half)
        pairs = own[k].groupBy("conv", (F.col("pos") - place).alias("at")).agg(F.max(F.when(place == 0, F.col("name"))).alias("left"), F.max(F.when(place == half, F.col("name"))).alias("right"))
        pairs = stored(pairs.where("right is not null"), "pairs")
        k += 1
        own[k] = stored(pairs.join(names.of(pairs, ["left", "right"]), ["left", "right"]).select("conv", F.col("at").alias("pos"), "name"), "blocks")
        discard(pairs)
    found = [convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))]
    last = None  # prefixes with one binary digit less
    for level, blocks in own.items():
        whole = blocks.where("pos = 0").select("conv", F.lit(1 << level).cast("long").alias("depth"), "name")
        last = whole if last is None else last.union(whole)
    if last is not None:
        found.append(last)
    for digits in range(2, longest.bit_length() + 1):
        after = None
        for level, blocks in own.items():
            # Blocks that a prefix ends with: its other digits are higher ones.
            ends = blocks.where((F.bit_count("pos") == digits - 1) & (F.expr("pos & -pos") > 1 << level)).select("conv", F.col("pos").alias("depth"), F.col("name").alias("right"), F.lit(1 << level).cast("long").alias("size"))
            after = ends if after is None else after.union(ends)
        pairs = after.join(last.withColumnRenamed("name", "left"), ["conv", "depth"]).select("conv", (F.col("depth") + F.col("size")).alias("depth"), "left", "right")
        pairs = stored(pairs, "pairs")
        last = stored(pairs.join(names.of(pairs, ["left", "right"]), ["left", "right"]).select("conv", "depth", "name"), "prefixes")
        discard(pairs)
        found.append(last)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return stored(out, "prefixes")


def _digests(ends: DataFrame) -> DataFrame:
    """Per ``name`` the SHA-256 of its ``conv`` ids in order, comma-joined.

    Ids are written in chunks by tasks that hold ranges of them; a name's chunks, in order, are hashed by one task that holds one of them.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, text = None, 0, bytearray()

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["name", "first", "ids"])

        for batch in batches:
            out = []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != name or len(text) > CHUNK:
                    if text:
                        out.append((name, first, bytes(text)))
                    name, first, text = n, c, bytearray()
                text += b"%d," % c
                if len(out) > 10_000:
                    yield done(out)
                    out = []
            if out:
                yield done(out)
        if text:
            yield done([(name, first, bytes(text))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, waiting = None, None, b""
        for batch in batches:
            out = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if n != name:
                    if state:
                        state.update(waiting[:-1])
                        out.append((name, state.hexdigest()))
                    name, state, waiting = n, hashlib.sha256(), b""
                state.update(waiting)
                waiting = ids.as_py()
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names=["name", "ends_sha256"])
        if state:
            state.update(waiting[:-1])
            yield pa.record_batch([pa.array([name], pa.int64()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    ranged = ends.repartitionByRange(_partitions(ends), "name", "conv").sortWithinPartitions("name", "conv")
    written = stored(ranged.mapInArrow(chunks, "name long, first long, ids binary"), "end-ids")
    return written.repartition("name").sortWithinPartitions("name", "first").mapInArrow(hashed, "name long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations: one row per node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    Turns stand in the order of ``turn`` (null first); rows with one number in the order of the SHA-256 of role and text. Null roles and texts are
    empty. Each conversation c is rebuilt: the first h turns of conversation c - c % 20 (h: CRC-32 of c in decimal, modulo 4), then its own turns
    after its first h. Rows without ``conv_id`` belong to no conversation and give nothing. An empty table gives no rows (there is no
    member for a root); other columns are not read.
    """
    turns, convs = rebuilt(conversations)
    rows = prefixes(turns, convs)
    nodes = stored(rows.groupBy("name").agg(F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs")), "nodes")
    above = rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    last = turns.select("conv", (F.col("pos") + 1).alias("depth"), "words")
    inner = nodes.join(above, ["conv", "depth"], "left").join(last, ["conv", "depth"], "left")
    inner = stored(inner.select("name", "conv", "depth", "n_convs", "parent", F.coalesce("words", F.lit(0)).alias("words")), "nodes")
    children = inner.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    tree = inner.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = stored(tree.select("name", "conv", "depth", "n_convs", "parent", "n_children", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "nodes")
    # What each conversation owns from a depth on: running sums from its end.
    owned = tree.select("conv", "depth", F.col("saved").alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    owned = rows.join(owned, ["conv", "depth"], "left").select("conv", (-F.col("depth")).alias("up"), "name", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"))
    owned = running(stored(owned, "owned"), "conv", ["up"], ["saved_tokens", "n_leaves"])
    sums = owned.groupBy("name").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = stored(convs.join(rows, ["conv", "depth"]).select("name", "conv"), "ends")
    up = tree.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = tree.join(sums, "name").join(_digests(ends), "name", "left").join(up, "parent", "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
