"""The structural summary of documents, and selections by class, id and attribute as CSS has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.axes import inside
from thicket.sources.shred import ATTRIBUTE, ELEMENT, TEXT


def structural_summary(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Per document: elements, elements of some names, attributes and characters of text, in one aggregation."""
    of = [F.count(F.when((F.col("kind") == ELEMENT) & (F.col("local") == n), 1)).alias(f"n_{n}") for n in names]
    return nodes.groupBy("doc_id").agg(
        F.count(F.when(F.col("kind") == ELEMENT, 1)).alias("n_elements"),
        *of,
        F.count(F.when(F.col("kind") == ATTRIBUTE, 1)).alias("n_attributes"),
        F.coalesce(F.sum(F.when(F.col("kind") == TEXT, F.length("value"))), F.lit(0)).alias("text_length"),
        F.max("level").alias("depth"),
    )


def by_attribute(elements: DataFrame, nodes: DataFrame, name: str, matches: Column) -> DataFrame:
    """Elements with an attribute whose ``value`` meets a condition (of any of CSS's operators)."""
    hit = nodes.where((F.col("kind") == ATTRIBUTE) & (F.col("local") == name) & matches).select("doc_id", F.col("parent").alias("pre"))
    return elements.join(hit.distinct(), ["doc_id", "pre"], "left_semi")


def has_word(word: str) -> Column:
    """``[a~=word]``, and of class ``.word``."""
    return F.array_contains(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), word)


def by_class(elements: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    return by_attribute(elements, nodes, "class", has_word(name))


def nth(elements: DataFrame, a: int, b: int) -> DataFrame:
    """``:nth-child(an+b)``: elements that are at such a place among their parent's elements."""
    k = F.col("elem")
    return elements.where((k == b) if a == 0 else (((k - b) % a == 0) & ((k - b) / a >= 0)))


def attribute_matches(operator: str, value: str) -> Column:
    """CSS's ``[a op value]`` on ``value``: "=", "~=" (a word), "|=" (or a prefix before a hyphen), "^=", "$=", "*="."""
    v = F.col("value")
    if operator in ("^=", "$=", "*=") and not value:
        return F.lit(False)
    return {"=": v == value, "~=": has_word(value), "|=": (v == value) | F.startswith(v, F.lit(value + "-")), "^=": F.startswith(v, F.lit(value)), "$=": F.endswith(v, F.lit(value)), "*=": F.contains(v, F.lit(value))}[operator]


def combined(left: DataFrame, combinator: str, right: DataFrame) -> DataFrame:
    """Elements of ``right`` that stand to one of ``left`` as CSS's " " (below), ">" (child), "+" (next) or "~" (later sibling) say."""
    own = left.select("doc_id", "pre", "parent", "elem").distinct()
    if combinator == " ":
        below = inside(right.select("doc_id", "pre", "last"), left.select("doc_id", "pre", "size").distinct(), itself=False)
        return right.join(below.select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_semi")
    if combinator == ">":
        return right.join(own.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi")
    if combinator == "+":
        return right.join(own.select("doc_id", "parent", (F.col("elem") + 1).alias("elem")), ["doc_id", "parent", "elem"], "left_semi")
    first = own.groupBy("doc_id", "parent").agg(F.min("elem").alias("_first"))
    return right.join(first, ["doc_id", "parent"]).where(F.col("elem") > F.col("_first")).drop("_first")
