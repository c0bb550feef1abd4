"""Tables that are written once to the folder that the driver and the executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session in local mode (one machine, as in tests) gets a temporary folder and the setting is made;
    on a cluster that is an error, as its machines share no temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set(CHECKPOINT_DIR, base)
    return base.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows are made once, the lineage ends, lost executors cost nothing.

    The files of its shuffles go when it is written: nothing reads them again, and a job of many steps would otherwise hold all of them
    until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` that no join sends whole to the driver and every task. Spark guesses the size of what Python made, or of compressed files, from
    bytes that may be a small part of it, and would broadcast a table of any length. The hint holds up to the next join."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` returned: for their owner, when all that was made from them is stored itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table just read, dealt over the session's cores if it has fewer files than these (a small file is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
