"""Homomorphic document fingerprints, with DataFrame functions only.

A paragraph (what lies between line feeds) has a wide vector of counters modulo 2**32:

* 8 lanes cut from the SHA-256 of the paragraph, which tell multisets of paragraphs apart;
* 128 lanes that count, for each bit of two 64-bit hashes, the paragraph's word trigrams that have it
  set, and one lane that counts the trigrams. Centred, they are random projections, so their cosine
  estimates how alike two texts are (with a standard error of about 1/sqrt(128)).

A document's fingerprint is the sum of its paragraphs' vectors modulo 2**32, whatever their order.
Inserting or deleting a paragraph adds or subtracts its vector (``combined``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.common import stored

STRONG = 8
HALF = 64
MOD = 1 << 32
LOWEST = -(1 << 63)


def paragraph_digests(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))


def strong_lanes(digests: Column) -> Column:
    def lane(i: int) -> Column:
        return F.aggregate(digests, F.lit(0).cast("long"), lambda total, d: (total + F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long")) % MOD)

    return F.array(*(lane(i) for i in range(STRONG)))


def trigrams(text: Column) -> Column:
    """A hash of each word of a paragraph with the two that follow it (fewer at its end)."""
    # The words are an argument of the second function, so they are split once and not once for each word.
    split = F.transform(F.split(text, "\n", -1), lambda p: F.split(p, " "))
    return F.flatten(F.transform(split, lambda words: F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred counters of two vectors of ``lanes`` (0 to 1); 1 for equal vectors."""
    n_a, n_b = F.element_at(a, -1), F.element_at(b, -1)

    def dot(x: Column, y: Column, n: Column, m: Column) -> Column:
        products = F.zip_with(F.slice(x, 1, 2 * HALF), F.slice(y, 1, 2 * HALF), lambda p, q: (2 * p - n).cast("double") * (2 * q - m).cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)

    size = F.sqrt(dot(a, a, n_a, n_a) * dot(b, b, n_b, n_b))
    cosine = F.when(size > 0, dot(a, b, n_a, n_b) / size).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def written(strong: Column, lanes: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a lane."""
    return F.array_join(F.transform(F.concat(strong, lanes), lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Sum (or with ``sign=-1`` difference) of two written fingerprints, lane by lane modulo 2**32."""

    def lanes(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.length(x) / 8).cast("int") - 1), lambda i: F.conv(F.substring(x, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))

    total = F.zip_with(lanes(a), lanes(b), lambda x, y: F.pmod(x + sign * y, F.lit(MOD)))
    return F.array_join(F.transform(total, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def vectors(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys`` and ``lanes`` (128 counters and the number of trigrams) of the texts in ``column``."""
    grams = texts.select(*keys, F.explode(trigrams(F.col(column))).alias("g"))
    two = grams.select(*keys, "g", F.xxhash64("g").alias("g2"))
    # Two counters of 32 bits in each 64-bit sum; below 2**31 trigrams they can't run into each other.
    sums = [F.sum(F.shiftright("g", i).bitwiseAND(1) + F.shiftleft(F.shiftright("g2", i).bitwiseAND(1), 32)).alias(f"s{i}") for i in range(HALF)]
    counted = two.groupBy(*keys).agg(*sums, F.count("*").alias("n"))
    low = [F.col(f"s{i}").bitwiseAND(MOD - 1).cast("int") for i in range(HALF)]
    high = [F.shiftrightunsigned(f"s{i}", 32).cast("int") for i in range(HALF)]
    return counted.select(*keys, F.array(*low, *high, F.col("n").cast("int")).alias("lanes"))


def _successors(ids: DataFrame) -> DataFrame:
    """For each (k, h) its successor in their order; the first follows the last.

    Rows are range-partitioned; the window runs in each partition, and one row per partition tells
    which row follows its last. No text is in these rows.
    """
    ranged = stored(ids.repartitionByRange("k", "h").withColumn("part", F.spark_partition_id()), "ranged-ids")
    own = F.struct("k", "h")
    inner = ranged.withColumn("next", F.lead(own).over(Window.partitionBy("part").orderBy("k", "h")))
    firsts = ranged.groupBy("part").agg(F.min(own).alias("first"))
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(everything)).alias("after"))
    joined = inner.join(after, "part").withColumn("next", F.coalesce("next", "after"))
    return stored(joined.select("k", "h", "known", "copies", "n_chars", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h")), "successors")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all) of the
    next document in ascending ``doc_id`` (after the last: the first). Returns ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``, a row per row
    of ``docs``. Null texts count as empty. Null ``doc_id`` come first; rows of one ``doc_id`` are ordered by a
    hash of their text; rows with equal ``doc_id`` and text are one document, repeated in the result.
    Other columns are not read. A single document is its own successor.
    """
    # The order needs a key without nulls, so that joins keep the partitioning of the texts.
    known = F.col("doc_id").isNotNull()
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("k"), F.xxhash64(text, known).alias("h"), known.alias("known"), text.alias("text"))
    ids = base.groupBy("k", "h").agg(F.first("known").alias("known"), F.count("*").alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    links = _successors(ids)
    own = base.groupBy("k", "h").agg(F.first("text").alias("text"))
    wanted = links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n_chars") / 2).cast("int").alias("take"))
    heads = own.join(wanted, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.substring("text", F.lit(1), F.col("take")).alias("head"))
    n = F.length("text")
    both = own.join(heads, ["k", "h"]).select("k", "h", "text", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("head")).alias("edited"))
    # One row a text, without a shuffle; the sums stay in the partitions of the documents.
    sides = both.select("k", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("e")).select("k", "h", "e.side", "e.t")
    strong = sides.select("k", "h", "side", strong_lanes(paragraph_digests(F.col("t"))).alias("strong"), F.when(F.col("side") == 1, F.sha2("t", 256)).alias("sha"), F.col("t"))
    lanes = vectors(strong, ["k", "h", "side", "strong", "sha"], "t")

    def side(i: int, name: str) -> Column:
        return F.first(F.when(F.col("side") == i, F.col(name)), ignorenulls=True)

    wide = lanes.groupBy("k", "h").agg(side(0, "strong").alias("strong"), side(1, "strong").alias("edited_strong"), side(0, "lanes").alias("lanes"), side(1, "lanes").alias("edited_lanes"), side(1, "sha").alias("edited_sha256"))
    prints = stored(wide, "fingerprints")
    follower = prints.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("lanes").alias("next_lanes"))
    joined = prints.join(links, ["k", "h"]).join(follower, ["next_k", "next_h"])
    result = joined.select(
        F.when(F.col("known"), F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        written(F.col("strong"), F.col("lanes")).alias("fingerprint"),
        written(F.col("edited_strong"), F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
        "copies",
    )
    return result.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
