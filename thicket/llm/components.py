"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) for every node of ``edges`` (two long columns).

    Loops and repeated edges don't matter; edges with a null end are left out; no edges give no rows.
    Every step is an aggregation with a partial one before it, and a join whose both sides are plain
    shuffles (so adaptive execution splits the rows of a node with many links). Steps are written to the
    shared folder; two numbers a round reach the driver. Nodes must hold no link to be left out of it.
    """
    a, b = edges.columns[:2]
    u, v = F.greatest(a, b), F.least(a, b)
    edges = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.union(edges.select("v", "u"))
        first = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-min")
        large = stored(both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        own = least.select("u", F.col("m").alias("v"))
        others = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, old = stored(own.union(others).distinct(), "small-star"), edges
        discard(old, first, large, least)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
