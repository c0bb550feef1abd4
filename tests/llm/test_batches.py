"""Batches of rows that the pipeline's stages send to Python."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from thicket.llm.common import BATCH_BYTES, small_batches


def test_stages_send_small_batches(spark):
    """30 MB of texts in one partition are one batch by Spark's own settings."""

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["bytes"])

    docs = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 2800).alias("text"))
    few = docs.where("doc_id < 3").withColumn("source", F.lit("a"))
    try:
        for stage in (corpus_pipeline.drop_repeated_passages, corpus_pipeline.pack_sequences):
            spark.conf.unset(BATCH_BYTES)
            stage(spark, few, "")
            assert max(r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect()) < 6 << 20
        spark.conf.set(BATCH_BYTES, "9m")
        small_batches(spark)
        assert spark.conf.get(BATCH_BYTES) == "9m"
    finally:
        spark.conf.unset(BATCH_BYTES)
