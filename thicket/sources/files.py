"""Reading documents and flat XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (a hash of the path), ``uri`` and ``content`` of whole files; Spark opens compressed ones."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("uri"), F.col("value").alias("content"))


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: str, **options: str) -> DataFrame:
    """Flat XML files as rows, with an explicit schema (inference takes texts like T1 for times)."""
    return spark.read.format("xml").option("rowTag", row_tag).options(**options).schema(schema).load(path)


def decoded(content: Column, first_bytes: Column | None = None) -> Column:
    """Text of binary content by its byte order mark; UTF-8 without one."""
    head = F.hex(F.substring(content if first_bytes is None else first_bytes, 1, 3))
    return (
        F.when(head.startswith("EFBBBF"), F.decode(F.substring(content, F.lit(4), F.length(content)), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16BE"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def line_ends(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def resolved(uris: DataFrame, catalog: DataFrame, column: str = "uri") -> DataFrame:
    """Adds ``resolved``: the catalog's exact entry for a URI, else its longest rewriting prefix applied, else the URI.

    ``catalog``: ``kind`` ('uri', 'system', 'public' or 'rewrite'), ``name``, ``target``.
    """
    exact = catalog.where("kind <> 'rewrite'").groupBy("name").agg(F.min("target").alias("exact"))
    rules = catalog.where("kind = 'rewrite'").select(F.col("name").alias("rule"), F.col("target").alias("to"))
    distinct = uris.select(F.col(column).alias("name")).distinct()
    # A URI has a head for each length that rules have, so the rules are found by an equi-join and not by comparing each with each.
    lengths = rules.agg(F.collect_set(F.length("rule")).alias("lengths"))
    prefix = distinct.crossJoin(F.broadcast(lengths)).select("name", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("name"))
    prefix = prefix.select("name", F.substring(F.col("name"), F.lit(1), F.col("n")).alias("head"))
    hit = prefix.join(rules, F.col("head") == F.col("rule")).groupBy("name").agg(F.max_by(F.struct("rule", "to"), F.length("rule")).alias("best"))
    table = distinct.join(exact, "name", "left").join(hit, "name", "left")
    rewritten = F.concat(F.col("best.to"), F.substring(F.col("name"), F.length("best.rule") + 1, F.length("name")))
    table = table.select(F.col("name").alias("_name"), F.coalesce("exact", rewritten, "name").alias("resolved"))
    return uris.join(table, F.col(column) == F.col("_name"), "left").drop("_name")
