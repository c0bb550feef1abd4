"""What a stage leaves on disk while the next ones run."""

import os
import time

import corpus_pipeline
from pyspark.sql import functions as F

from thicket.sources.store import shared_folder, stored


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(blocks.size()) if (name := blocks.apply(k).getName()).startswith("shuffle")}


def test_stored_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "test")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:  # they are deleted in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert sorted(rows.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_stages_delete_what_they_stored(spark):
    """Only small tables that a stage's own result is read from are left, and the last links of components."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k % 8 * 40 : k % 8 * 40 + 80]) + (f" end{k}" if k % 3 else "") for k in range(48)]
    docs = spark.createDataFrame([(k, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = shared_folder(spark).removeprefix("file://")
    for stage, left in ((corpus_pipeline.drop_near_copies, {"staying-rows", "small-star"}), (corpus_pipeline.drop_repeated_passages, {"document-spans"}), (corpus_pipeline.mix_sources, {"mix-times"})):
        before = set(os.listdir(folder))
        assert stage(spark, docs, "").count()
        assert {name[:-33] for name in set(os.listdir(folder)) - before} <= left
