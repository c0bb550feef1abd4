"""Exact Jaccard join of word shingle sets with PartEnum signatures.

Sets of sizes within a band of the ratio of the threshold differ in at most k elements
if they are similar enough. The domain of shingle hashes is cut into n1 parts and each into
three; of k differences, some part has at most one, so two of its three thirds agree. A
signature is the hash of the elements in two thirds of a part, so similar sets share one.
A set signs for its own band and the next, which covers pairs across bands.

Equal sets are one class and stand once. Sets that share a signature form a bucket and are
compared with one hub; what links joins one component. Only members of different components are
compared further: in small buckets pair by pair, in large ones by exact bounds from sketches, in blocks inside of
tasks, those of one hub together. So every two similar sets end in one component, and no group's pairs are written out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import claim, discard, mix64, stored, tidy, utf8_values
from thicket.llm.components import connected_components
from thicket.llm.words import WordHashes, grams

SETS = "doc_id long, n_shingles long, set_hash long, sketch binary"
SIGNED = "bucket int, links boolean, packed binary"
LINKS = "sig long, hub long, id long"
KEY = 5  # bytes of a signature within its bucket: of a million, one pair in two such buckets is equal by chance
FLUSH = 800_000  # signatures that a task combines at a time
PER_BUCKET = 1_000_000  # signatures of a bucket that one task sorts, on average
MOST_PARTITIONS = 20_000  # of the shuffle of signatures; more buckets share these
BROADCAST_ROWS = 500_000  # of 16 bytes each
SMALL_BUCKET = 24  # members of a bucket that may be paired by a join
BLOCK = 1024  # sketches of a block ..
BLOCK_BYTES = 8 << 20  # .. and their bytes, but for a larger single one
SPOKES = 256  # texts that one task compares with one text


@lru_cache(maxsize=4)
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest size of each band, and the parts (n1) that sets of a band and the one below need."""
    upper = [1]
    while upper[-1] < 1 << 31:
        upper.append(max(upper[-1] + 1, (upper[-1] + 1) * den // num))
    most = np.array(upper, np.int64)
    k = 2 * most * (den - num) // (den + num)
    return most, np.where(k > 0, (k + 2) // 2, 0)


def shingle_set(raw: bytes, words: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (UTF-8); A-Z count as a-z."""
    return np.unique(grams(words.of(raw.lower().split()), n))


def set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the elements in cells: two sketches differ in no more bits than the sets in elements."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    most, parts = bands(num, den)
    own = int(np.searchsorted(most, len(s)))
    out = []
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
        for band in (own, own + 1):
            if n1 := int(parts[band]):
                step = (1 << 64) // (3 * n1)
                at = np.concatenate([[0], np.searchsorted(s, np.arange(1, 3 * n1, dtype=np.uint64) * np.uint64(step)), [len(s)]])
                third = (total[at[1:]] - total[at[:-1]]).reshape(n1, 3)
                two = third.sum(axis=1, dtype=np.uint64)[:, None] - third
                name = mix64(np.arange(3 * n1, dtype=np.uint64) + np.uint64(band << 40)).reshape(n1, 3)
                out.append(mix64(two + name).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(docs: DataFrame, n: int, *carried: str) -> DataFrame:
    """For each row: number of distinct shingles, a hash of their set (null: no word), its sketch and the string columns ``carried``; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            size, hashes, sketches = [], [], []
            for raw in utf8_values(batch.column(1)):
                s = shingle_set(raw, words, n)
                size.append(len(s))
                hashes.append(set_hash(s) if len(s) else None)
                sketches.append(sketch(s) if len(s) else None)
            own = [c.cast(pa.string()) for c in batch.columns[2:]]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sketches, pa.binary()), *own], names=["doc_id", "n_shingles", "set_hash", "sketch", *carried])

    return stored(docs.select("doc_id", "text", *carried).mapInArrow(tidy(run), ", ".join([SETS, *(f"{c} string" for c in carried)])), "shingle-sets")


def _stars(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of (signature, id) pairs: each signature with its smallest id; and those with each other id."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    hub = ids[first][np.cumsum(first) - 1]
    rest = ~first & np.concatenate([[False], (ids[1:] != ids[:-1]) | (sig[1:] != sig[:-1])])
    return sig[first], ids[first], sig[rest], hub[rest], ids[rest]


def _pack(keys: np.ndarray, ids: np.ndarray) -> bytes:
    """Keys in ``KEY`` bytes, ids as places in the list of the distinct ones."""
    distinct, place = np.unique(ids, return_inverse=True)
    place = place.astype("<u2" if len(distinct) <= 1 << 16 else "<u4")
    head = np.array([len(keys), len(distinct)], "<u4").tobytes()
    return b"".join([head, keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes(), distinct.astype("<i8").tobytes(), place.tobytes()])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, distinct = np.frombuffer(raw, "<u4", 2).tolist()
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :KEY] = np.frombuffer(raw, np.uint8, KEY * n, 8).reshape(n, KEY)
    at = 8 + KEY * n
    place = np.frombuffer(raw, "<u2" if distinct <= 1 << 16 else "<u4", n, at + 8 * distinct)
    return keys.view("<u8").ravel(), np.frombuffer(raw, "<i8", distinct, at)[place]


def candidate_links(docs: DataFrame, n: int, num: int, den: int, shingles: int) -> DataFrame:
    """(signature, hub, id) stars over the sets that share a signature; ids are set hashes; stored.

    A task links its own sets of a signature itself and sends only the smallest on, so a signature is sent no more often than
    there are flushes of tasks. What it sends is packed by buckets of signatures, whose number follows from that of all
    ``shingles``, so that a bucket has some ``PER_BUCKET`` signatures whatever the input. Signatures are cut to 40 bits (fewer for very
    many buckets) within their bucket; a collision is a candidate more, which the verification drops.
    """
    # About one signature in six parts of the differences that a shingle stands for, in two bands.
    buckets = max(1, -(-shingles * 6 * (den - num) // ((den + num) * PER_BUCKET)))
    bits = min(8 * KEY, 62 - buckets.bit_length())
    low = (1 << bits) - 1

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sigs, ids, waiting, several = WordHashes(), [], [], 0, np.uint64(buckets)

        def flush() -> Iterator[pa.RecordBatch]:
            sig = np.concatenate(sigs)
            bucket, key = (sig % several).astype(np.int64), (sig // several) & np.uint64(low)
            # Signatures of a bucket next to each other, equal ones too.
            a_sig, a_id, b_sig, b_hub, b_id = _stars(bucket << bits | key.view(np.int64), np.concatenate(ids))
            edge = np.searchsorted(a_sig, np.arange(buckets + 1, dtype=np.int64) << bits)
            filled = np.flatnonzero(np.diff(edge))
            for some in np.array_split(filled, -(-len(filled) // 5000)) if len(filled) else ():
                yield _rows(some, False, [_pack((a_sig[edge[k] : edge[k + 1]] & low).astype(np.uint64), a_id[edge[k] : edge[k + 1]]) for k in some])
            for k in range(0, len(b_sig), 50_000):
                part = slice(k, k + 50_000)
                anywhere = mix64(b_id[part][:1].view(np.uint64)) % several
                yield _rows(anywhere, True, [np.stack([b_sig[part], b_hub[part], b_id[part]]).astype("<i8").tobytes()])

        for batch in batches:
            for raw in utf8_values(batch.column(0)):
                s = shingle_set(raw, words, n)
                if len(own := signatures(s, num, den)):
                    sigs.append(own)
                    ids.append(np.full(len(own), set_hash(s), np.int64))
                    waiting += len(own)
                if waiting >= FLUSH:
                    yield from flush()
                    sigs, ids, waiting = [], [], 0
        if waiting:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        last, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            keys, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            _, _, sig, hub, own = _stars(keys.view(np.int64) | last << bits, ids)
            for k in range(0, len(sig), 100_000):
                yield _links(sig[k : k + 100_000], hub[k : k + 100_000], own[k : k + 100_000])

        for batch in batches:
            for bucket, links, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if links:
                    yield _links(*np.frombuffer(raw.as_py(), "<i8").reshape(3, -1))
                    continue
                if bucket != last and held:
                    yield from settle()
                    held = []
                last = bucket
                held.append(_unpack(raw.as_py()))
        if held:
            yield from settle()

    signed = docs.select("text").mapInArrow(tidy(sign), SIGNED)
    return stored(signed.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), LINKS), "signature-links")


def _rows(buckets: np.ndarray, links: bool, packed: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(buckets.astype(np.int32)), pa.array([links] * len(packed)), pa.array(packed, pa.binary())], names=["bucket", "links", "packed"])


def _links(sig: np.ndarray, hub: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(sig), pa.array(hub), pa.array(ids)], names=["sig", "hub", "id"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of set hashes whose sets are similar enough, by their sketches and then by their texts; stored."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, other = (batch.column(i).to_pylist() for i in (2, 4))
            keep = [min(x, y) * den >= max(x, y) * num and sketch_distance(s, t) * (den + num) <= (x + y) * (den - num) for x, s, y, t in zip(size, batch.column(3).to_pylist(), other, batch.column(5).to_pylist(), strict=True)]
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    info = [classes.select(F.col("set_hash").alias(i), F.col("n_shingles").alias(f"n_{i}"), F.col("sketch").alias(f"s_{i}")) for i in "ab"]
    close = pairs.join(info[0], "a").join(info[1], "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    close = stored(close.mapInArrow(tidy(near), "a long, b long"), "near-pairs")
    needed = close.select("a").union(close.select("b")).distinct().withColumnRenamed("a", "set_hash").join(classes.select("set_hash", "doc_id"), "set_hash")
    needed = stored(needed, "needed")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:  # a repeated doc_id can bring a text of another set
            keep = [set_hash(shingle_set(raw, words, n)) == h for h, raw in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts = docs.select("doc_id", "text").join(few, "doc_id").select("set_hash", "text")
    texts = stored(texts.mapInArrow(tidy(own), "set_hash long, text string").dropDuplicates(["set_hash"]), "needed-texts")
    found = _similar(close, texts, n, num, den)
    discard(close, needed, texts)
    return found


def _similar(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets are similar enough; stored.

    Of a pair, the end with more pairs is the hub, and its spokes are dealt to blocks. A task reads a hub's text once a block
    and holds its set; the spokes' texts stream by one after another, so no more than two sets are held, of whatever size.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    one, other = (degree.select(F.col("id").alias(i), F.col("degree").alias(f"d_{i}")) for i in "ab")
    known = pairs.join(one, "a").join(other, "b")
    first = F.col("d_a") >= F.col("d_b")
    block = F.pmod(F.xxhash64("spoke"), F.ceil(F.greatest("d_a", "d_b") / SPOKES)).cast("int")
    dealt = known.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("spoke"), "d_a", "d_b")
    dealt = stored(dealt.select("hub", block.alias("block"), "spoke"), "dealt-pairs")
    hubs = dealt.select("hub", "block").distinct().withColumn("spoke", F.lit(None).cast("long"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = WordHashes(), np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, spoke, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), utf8_values(batch.column(3)), strict=True):
                s = shingle_set(text, words, n)
                if spoke is None:
                    own = s
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both * den >= num * (len(own) + len(s) - both):
                    a.append(min(hub, spoke))
                    b.append(max(hub, spoke))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    at_hub = hubs.join(texts.withColumnRenamed("set_hash", "hub"), "hub").select("hub", "block", "spoke", "text")
    at_spoke = dealt.join(texts.withColumnRenamed("set_hash", "spoke"), "spoke").select("hub", "block", "spoke", "text")
    rows = at_hub.union(at_spoke).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("spoke").asc_nulls_first())
    found = stored(rows.mapInArrow(tidy(compare), "a long, b long"), "similar-pairs")
    discard(dealt)
    return found


def _linked(links: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Components of set hashes (those with links only), from the buckets of candidates (stored, deleted when read); stored.

    First every bucket's members are compared with one of them, the one that most buckets share (of an original and its
    edited copies, the original). Of buckets whose members are in several components after that, small ones are paired one
    by one, and large ones are compared by their sketches, block by block in tasks, so that only pairs leave that can be
    similar. A pair of a bucket goes untested only if both already are in one component.
    """
    members = stored(links.select("sig", F.col("hub").alias("id")).union(links.select("sig", "id")).distinct(), "members")
    discard(links)
    scored = stored(members.join(members.groupBy("id").agg(F.count("*").alias("score")), "id"), "scored-members")
    discard(members)
    place = F.struct("score", "id")
    hubs = stored(scored.groupBy("sig").agg(F.max(place).alias("last")), "hubs")
    spokes = scored.join(hubs, "sig").where(F.col("id") != F.col("last.id"))
    tried = stored(spokes.select(F.least("id", "last.id").alias("a"), F.greatest("id", "last.id").alias("b")).distinct(), "tried-pairs")
    edges = verified(tried, classes, docs, n, num, den)
    found = stored(connected_components(edges), "components")
    # Buckets whose members are still in several components.
    labelled = stored(scored.join(found, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component")), "labelled-members")
    discard(scored)
    mixed = labelled.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x < y")
    mixed = stored(mixed.join(hubs, "sig").select("sig", "m", F.col("last.id").alias("hub")), "mixed-buckets")
    members = stored(labelled.join(mixed, "sig"), "open-members")
    discard(labelled, mixed, hubs)
    small = members.where(F.col("m") <= SMALL_BUCKET)
    one, other = (small.select("sig", F.col("id").alias(i), F.col("component").alias(f"c_{i}")) for i in "ab")
    pairs = one.join(other, "sig").where("a < b and c_a <> c_b").select("a", "b")
    large = members.where(F.col("m") > SMALL_BUCKET)
    clustered = _near_in_clusters(large, classes, num, den)
    pairs = stored(pairs.union(clustered).distinct().join(tried, ["a", "b"], "left_anti"), "new-pairs")
    discard(members, clustered, tried)
    more = verified(pairs, classes, docs, n, num, den)
    discard(pairs)
    if more.limit(1).count():
        discard(found)
        found = stored(connected_components(edges.union(more)), "components")
    discard(edges, more)
    return found


def _near_in_clusters(members: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of ids that can be similar by their sketches, among ids that large buckets bring together; stored.

    Buckets with one ``hub`` form a cluster, whose ids are compared once: most buckets of an original and its edited copies have the
    original as their hub, while buckets that unrelated texts share don't chain into one cluster. Its ids are dealt to bands of size, of which only one and the
    next can hold similar sets, and these to blocks, bounded by rows and by bytes. Each pair of blocks of a band, or of one and the
    next, is a group of some 2 * BLOCK rows with their sketches, and only pairs of different components within the bound leave it.
    """
    rows = members.select(F.col("hub").alias("cluster"), "id", "component").distinct()
    rows = rows.join(classes.select(F.col("set_hash").alias("id"), "n_shingles", "sketch"), "id")
    # A little wider than the ratio of the threshold, against rounding.
    rows = stored(rows.withColumn("band", F.floor(F.log("n_shingles") / (1.0001 * max(math.log(den / num), 1e-6))).cast("int")), "cluster-members")
    sizes = stored(rows.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("sketch")) / BLOCK_BYTES)).cast("int").alias("blocks")), "cluster-sizes")
    near = lambda name, step: sizes.select("cluster", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    dealt = rows.join(sizes, ["cluster", "band"]).join(near("above", 1), ["cluster", "band"], "left").join(near("below", -1), ["cluster", "band"], "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def group(low: Column, i: Column, high: Column, j: Column, side: Column) -> Column:
        return F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), side.cast("int").alias("side"))

    def counted(n: str, to: Callable[[Column], Column]) -> Column:
        return F.transform(F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), to)

    band, block = F.col("band"), F.col("block")
    own = counted("blocks", lambda k: group(band, F.least(block, k), band, F.greatest(block, k), F.when(block == k, 2).when(block < k, 0).otherwise(1)))
    up = counted("above", lambda k: group(band, block, band + 1, k, F.lit(0)))
    down = counted("below", lambda k: group(band - 1, k, band, block, F.lit(1)))
    dealt = dealt.select("cluster", F.explode(F.concat(own, up, down)).alias("g"), "id", "component", "n_shingles", "sketch")
    dealt = dealt.select("cluster", "g.low", "g.i", "g.high", "g.j", "g.side", "id", "component", "n_shingles", "sketch")
    keys = ["cluster", "low", "i", "high", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        held: list[tuple] = []

        def settle() -> pa.RecordBatch:
            found = _near_pairs(held, num, den)
            return pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:5] != held[0][:5]:
                    yield settle()
                    held = []
                held.append(row)
        if held:
            yield settle()

    found = stored(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(compare), "a long, b long"), "cluster-pairs")
    discard(rows, sizes)
    return found


def _near_pairs(rows: list[tuple], num: int, den: int) -> tuple[list[int], list[int]]:
    """Of one pair of blocks (five keys, side, id, component, size, sketch): pairs of ids, the smaller first. Side 2 is both sides."""
    side, ids, component, size = (np.array([r[k] for r in rows], np.int64) for k in (5, 6, 7, 8))
    widths = sorted({len(r[9]) for r in rows})
    folded: dict[int, np.ndarray] = {}
    for w in widths:  # each sketch at each narrower width that others have
        out = np.zeros((len(rows), w // 8), np.uint64)
        for k, r in enumerate(rows):
            if len(r[9]) >= w:
                out[k] = np.bitwise_xor.reduce(np.frombuffer(r[9], np.uint64).reshape(-1, w // 8), axis=0)
        folded[w] = out
    width = np.array([len(r[9]) for r in rows])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    a, b = [], []
    for x in left:
        y = right[(component[right] != component[x]) & (np.minimum(size[right], size[x]) * den >= np.maximum(size[right], size[x]) * num)]
        if side[x] == 2:
            y = y[y > x]
        for w in widths:
            z = y[np.minimum(width[y], width[x]) == w]
            if len(z):
                distance = np.bitwise_count(folded[w][z] ^ folded[w][x]).sum(axis=1, dtype=np.int64)
                z = z[distance * (den + num) <= (size[z] + size[x]) * (den - num)]
                a += np.minimum(ids[z], ids[x]).tolist()
                b += np.maximum(ids[z], ids[x]).tolist()
    return a, b


def jaccard_rows(docs: DataFrame, n: int, num: int, den: int, *carried: str) -> DataFrame:
    """``jaccard_components`` with a key of each row's component, ``component`` (null: the row links with nothing), and the
    string columns ``carried``. Where a ``doc_id`` is repeated, several components can have one ``component_id``.
    """
    return jaccard_tables(docs, n, num, den, *carried)[0]


def jaccard_tables(docs: DataFrame, n: int, num: int, den: int, *carried: str) -> tuple[DataFrame, list[DataFrame]]:
    """``jaccard_rows``, and the stored tables that it reads: a caller that stores what it makes of the rows may discard them."""
    docs = docs.select("doc_id", "text", *carried)
    sets = shingle_sets(docs, n, *carried)
    known = sets.where("set_hash is not null and doc_id is not null")
    classes = stored(known.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "set-classes")
    named = docs.select("doc_id", "text").where("doc_id is not null")
    shingles = known.agg(F.sum("n_shingles")).first()[0] or 0
    links = candidate_links(named, n, num, den, shingles)
    found = _linked(links, classes, named, n, num, den)
    label = classes.join(found, classes.set_hash == found.id, "left").select("set_hash", "doc_id", F.coalesce("component", "set_hash").alias("component"))
    label = stored(label, "class-components")
    discard(classes, found)
    least = stored(label.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    label, old = stored(label.join(least, "component").select("set_hash", "component", "component_id"), "class-labels"), label
    discard(old, least)
    linked = known.select("doc_id", "n_shingles", "set_hash", *carried).join(label, "set_hash").select("doc_id", "n_shingles", "component_id", "component", *carried)
    rest = sets.where("set_hash is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), *carried)
    return linked.union(rest), [sets, label]


def jaccard_components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Components of texts whose sets of ``n``-word shingles have den * intersection >= num * union.

    One row per row of ``docs``: ``doc_id``, ``n_shingles`` (0 without words) and ``component_id`` (the
    smallest ``doc_id`` reachable by links, itself included). Null or empty texts, and texts without words,
    link with nothing. Rows without ``doc_id`` come back with a null component and link with nothing. Rows
    that repeat a ``doc_id`` are texts like others. Equal sets always link. Other columns are not read.
    """
    return jaccard_rows(docs, n, num, den).select("doc_id", "n_shingles", "component_id")
