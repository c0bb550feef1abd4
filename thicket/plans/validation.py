"""Validation as queries: rules select rows, violations are what is left over."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.axes import step
from thicket.sources.shred import ATTRIBUTE, ELEMENT, TEXT


def asserted(rows: DataFrame, patterns: Mapping[str, Sequence[tuple[Column, str, Column]]]) -> DataFrame:
    """Schematron: in each pattern, the first rule whose context holds applies; rows that fail its assertion are reported.

    ``patterns``: name: [(context, message, assertion), ..]. Adds ``pattern`` and ``message``. Unknown counts as failed.
    """
    reports = []
    for name, rules in patterns.items():
        failed = F.lit(None).cast("string")
        for context, message, assertion in reversed(rules):
            verdict = F.when(~F.coalesce(assertion, F.lit(False)), F.lit(message))
            failed = F.when(F.coalesce(context, F.lit(False)), verdict).otherwise(failed)
        reports.append(F.struct(F.lit(name).alias("pattern"), failed.alias("message")))
    all_reports = rows.withColumn("_r", F.explode(F.array(*reports))).where("_r.message is not null")
    return all_reports.select("*", "_r.pattern", "_r.message").drop("_r")


def facets(value: Column, *, pattern: str | None = None, enumeration: Sequence[str] | None = None, length: tuple[int, int] | None = None, bounds: tuple[float | None, float | None] | None = None, digits: tuple[int, int] | None = None, white_space: str = "preserve") -> Column:
    """Names of the XSD facets that a value violates, as an array. A null value violates nothing."""
    text = value.cast("string")
    if white_space in ("replace", "collapse"):
        text = F.translate(text, "\t\n\r", "   ")
    if white_space == "collapse":
        text = F.trim(F.regexp_replace(text, " +", " "))
    number = text.try_cast("decimal(38,18)")
    bad = []
    if pattern is not None:
        bad.append(F.when(~text.rlike(f"^(?:{pattern})$"), "pattern"))
    if enumeration is not None:
        bad.append(F.when(~text.isin(*enumeration), "enumeration"))
    if length is not None:
        bad.append(F.when(~F.char_length(text).between(*length), "length"))
    if bounds is not None:
        low, high = bounds
        good = F.lit(True) if low is None else number >= F.lit(low)
        good = good if high is None else good & (number <= F.lit(high))
        bad.append(F.when(~F.coalesce(good, F.lit(False)) & text.isNotNull(), "bounds"))
    if digits is not None:
        plain = F.regexp_replace(F.regexp_replace(text, r"^[+-]?0*", ""), r"(\.\d*?)0+$", "$1")
        fraction = F.length(F.regexp_extract(plain, r"\.(\d+)$", 1))
        bad.append(F.when((F.length(F.translate(plain, ".", "")) > digits[0]) | (fraction > digits[1]), "digits"))
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def content_model(nodes: DataFrame, models: DataFrame) -> DataFrame:
    """DTD content models: elements whose children do not match.

    ``models``: ``local`` and ``model``, a regular expression over the names of the child elements, each followed by a
    space ('' is EMPTY, '.*' is ANY), and ``mixed`` (whether text is allowed). Elements without a model are reported as undeclared.
    """
    elements = nodes.where(F.col("kind") == ELEMENT)
    inside = step(elements, nodes, "child", F.col("kind").isin(ELEMENT, TEXT))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == ELEMENT, F.struct("pre", "local")))), lambda t: F.concat(t["local"], F.lit(" "))), "")
    text = F.coalesce(F.bool_or((F.col("kind") == TEXT) & F.col("value").rlike(r"\S")), F.lit(False))
    children = inside.groupBy("doc_id", "ctx").agg(names.alias("children"), text.alias("text")).withColumnRenamed("ctx", "pre")
    seen = elements.select("doc_id", "pre", "local").join(children, ["doc_id", "pre"], "left").join(F.broadcast(models), "local", "left")
    wrong = F.when(F.col("model").isNull(), "undeclared").when(~F.rlike(F.coalesce("children", F.lit("")), F.concat(F.lit("^(?:"), F.col("model"), F.lit(")$"))), "children").when(F.coalesce("text", F.lit(False)) & ~F.col("mixed"), "text")
    return seen.select("doc_id", "pre", "local", wrong.alias("violation")).where("violation is not null")


def with_defaults(nodes: DataFrame, defaults: DataFrame) -> DataFrame:
    """DTD attribute defaults: ``doc_id``, ``pre`` (of the element), ``name``, ``value`` of given and defaulted attributes.

    ``defaults``: ``local``, ``name``, ``value``.
    """
    given = nodes.where(F.col("kind") == ATTRIBUTE).select("doc_id", F.col("parent").alias("pre"), "name", "value")
    due = nodes.where(F.col("kind") == ELEMENT).select("doc_id", "pre", "local").join(defaults, "local").select("doc_id", "pre", "name", "value")
    return given.union(due.join(given, ["doc_id", "pre", "name"], "left_anti").select("doc_id", "pre", "name", "value"))
