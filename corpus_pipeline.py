"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from thicket.llm.common import discard, free, small_batches, stored, table
from thicket.llm.jaccard import jaccard_tables
from thicket.llm.mixing import Mixture, repeated
from thicket.llm.packing import pack, pieces
from thicket.llm.substring_dedup import without_repeats
from thicket.llm.toxicity import train, without_toxic

CAPACITY = 2048
ROOM = 64 << 20  # of a worker's memo of words: here executors still hold what four stages before left in them


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    small_batches(spark)
    return without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays: of the smallest doc_id, and
    among rows that repeat it, the one whose text has the smallest hash; of rows with that text too, the smallest row.

    So of a row that was ingested many times one stays, and rows of one doc_id with texts that are not alike all stay.
    Rows without doc_id, and rows without words, link with nothing and stay.
    """
    small_batches(spark)
    key = free(docs, "text_hash")
    hashed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    rows, made = jaccard_tables(hashed, 5, 80, 100, key)
    rows = stored(rows.where("doc_id is not null").groupBy("component", "doc_id", key).agg(F.when(F.col("component").isNull(), 1).otherwise(F.count("*")).alias("n")), "row-groups")
    discard(*made)
    least = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", key, "n")).alias("first")).select("first.*")
    staying = stored(least.union(rows.where("component is null").select("doc_id", key, "n")), "staying-rows")
    discard(rows)
    once = hashed.join(staying.where("n = 1"), ["doc_id", key], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    again = hashed.join(staying.where("n > 1"), ["doc_id", key], "left_semi")
    # Rows that repeat a doc_id and a text: the smallest of their other columns that can be ordered decides, then any.
    ordered = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = again.groupBy("doc_id", key).agg(F.min_by(whole, F.struct(*ordered)).alias("first")).select("first.*")
    return once.union(again).union(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by 50-word windows of an earlier document go; other texts stay as they are."""
    small_batches(spark)
    return without_repeats(docs, width=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated, at most twice as often as the largest; each document stays at least once."""
    return repeated(docs, Mixture(max_repeats=2.0, tokens=None))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their places in sequences of 2048 tokens."""
    small_batches(spark)
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, end_id=0, room=ROOM), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir).select(*(F.col(f"`{c}`") for c in docs.columns)), name)
    return STAGES[-1][1](spark, docs, sf_dir)
