"""Keyed look-ups, grouping, numbering, sorting and top-k: what stylesheets do with keys, xsl:number and xsl:sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(probe: DataFrame, keyed: DataFrame, value: str, key: str, how: str = "inner") -> DataFrame:
    """``key(name, value)``: rows of ``keyed`` whose ``key`` equals the probe's ``value``; a hash or merge join, as the sizes say."""
    return probe.join(keyed, probe[value] == keyed[key], how)


def distinct_keys(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in an order: Muenchian grouping's heads."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def dangling(rows: DataFrame, keyed: DataFrame, value: str, key: str) -> DataFrame:
    """Rows whose reference has no target (``xs:keyref``, IDREF)."""
    return rows.where(F.col(value).isNotNull()).join(keyed.select(F.col(key).alias(value)).distinct(), value, "left_anti")


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have (``xs:key``, ``xs:unique``, ID), and how many."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def number_single(rows: DataFrame, parent: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``xsl:number level="single"``: the place among the siblings counted."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*parent).orderBy(*order)))


def number_any(rows: DataFrame, document: list[str], order: list[str], counted: Column, restart: Column | None = None, name: str = "number") -> DataFrame:
    """``level="any"``: counted rows of the document up to each row, since the last one that meets ``restart``."""
    ahead = Window.partitionBy(*document).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if restart is None:
        return rows.withColumn(name, F.count(F.when(counted, 1)).over(ahead))
    parted = rows.withColumn("_part", F.count(F.when(restart, 1)).over(ahead))
    since = Window.partitionBy(*document, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parted.withColumn(name, F.count(F.when(counted, 1)).over(since)).drop("_part")


def number_multiple(levels: list[Column], separator: str = ".") -> Column:
    """``level="multiple"``: the numbers of the levels, joined."""
    return F.array_join(F.array(*(x.cast("string") for x in levels)), separator)


def sort_key(value: Column, data_type: str = "text", order: str = "ascending", language: str | None = None) -> Column:
    """A key of xsl:sort; numbers that are none come first ascending."""
    if data_type == "number":
        key = F.coalesce(value.cast("string").try_cast("double"), F.lit(float("-inf")))
    else:
        key = F.coalesce(value, F.lit(""))
        key = F.collate(key, language) if language else key
    return key.desc() if order == "descending" else key.asc()


def first_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """``[position() <= k]`` in each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def highest(rows: DataFrame, group: list[str], value: str, lowest: bool = False) -> DataFrame:
    """``math:highest``: the rows of a group that have its maximum (all of them)."""
    best = rows.groupBy(*group).agg((F.min(value) if lowest else F.max(value)).alias("_best"))
    return rows.join(best, group).where(F.col(value) == F.col("_best")).drop("_best")


def some_pair(a: DataFrame, b: DataFrame, group: list[str], operator: str) -> DataFrame:
    """Comparison of node sets: the groups in which some value of ``a`` and some value of ``b`` (columns ``value``, numbers or texts)
    are in a relation, =, !=, <, <=, > or >=. But for = two values of each side decide, so no pairs are made. Null and NaN are in none."""
    good = F.col("value").isNotNull() & ~F.coalesce(F.isnan(F.col("value").cast("string").try_cast("double")), F.lit(False))
    a, b = a.where(good), b.where(good)
    if operator == "=":
        return a.select(*group, "value").distinct().join(b.select(*group, "value").distinct(), [*group, "value"], "left_semi").select(*group).distinct()
    one, other = (d.groupBy(*group).agg(F.min("value").alias(f"{s}_low"), F.max("value").alias(f"{s}_high")) for d, s in ((a, "a"), (b, "b")))
    holds = {"!=": "a_low <> a_high or b_low <> b_high or a_low <> b_low", "<": "a_low < b_high", "<=": "a_low <= b_high", ">": "a_high > b_low", ">=": "a_high >= b_low"}
    return one.join(other, group).where(holds[operator]).select(*group)
