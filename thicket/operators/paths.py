"""Patterns over paths, matched once for each distinct path.

The path table has a row for each distinct path of element names, with its own name and the path around it. A pattern is an automaton whose
states are the steps matched so far. What a stretch of names does to each state is a list of bit masks, and two stretches
compose. So each path jumps to the path around it, then two up, four up .., and the masks with it: after about log2(depth) joins
each path knows what all its names do from the start, without the path ever being written out. Nodes are then found by the ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.sources.shred import ELEMENT
from thicket.sources.store import stored

CHILD, DESCENDANT = "child", "descendant"
MOST_STEPS = 60  # bits of a mask


def path_table(nodes: DataFrame) -> DataFrame:
    """``path_id``, ``path_up`` (0: the document), ``local`` and ``level`` of every distinct path of elements."""
    own = nodes.where(F.col("kind") == ELEMENT)
    return own.groupBy("path_id").agg(F.first("path_up").alias("path_up"), F.first("local").alias("local"), F.first("level").alias("level"))


def suffix(*names: str) -> list[tuple[str, str]]:
    """The pattern ``//a/b/..``."""
    return [(DESCENDANT if i == 0 else CHILD, n) for i, n in enumerate(names)]


def _own_masks(local: Column, pattern: Sequence[tuple[str, str]]) -> Column:
    """For each state (steps matched) the states that one name leads to."""
    masks = []
    for i in range(len(pattern) + 1):
        axis, name = pattern[i] if i < len(pattern) else (CHILD, None)
        stay = 1 << i if i < len(pattern) and axis == DESCENDANT else 0
        on = F.lit(stay).cast("long")
        if name == "*":
            on = F.lit(stay | 2 << i).cast("long")
        elif name is not None:
            on = F.when(local == name, F.lit(stay | 2 << i)).otherwise(F.lit(stay)).cast("long")
        masks.append(on)
    return F.array(*masks)


def _composed(first: Column, then: Column, states: int) -> Column:
    """The masks of one stretch of names after another."""

    def both(mask: Column) -> Column:
        out = F.lit(0).cast("long")
        for j in range(states):
            out = out.bitwiseOR(F.when(F.getbit(mask, F.lit(j)) == 1, then[j]).otherwise(F.lit(0).cast("long")))
        return out

    return F.transform(first, both)


def matching(paths: DataFrame, pattern: Sequence[tuple[str, str]]) -> DataFrame:
    """``path_id`` of the paths (see ``path_table``) that a pattern selects.

    ``pattern``: steps of (``CHILD`` or ``DESCENDANT``, a local name or ``"*"``) from the document, at most 60. Each round is written
    to the shared folder; one number a round reaches the driver.
    """
    if not 0 < len(pattern) <= MOST_STEPS:
        raise ValueError(f"{len(pattern)} steps")
    states = len(pattern) + 1
    now = stored(paths.select("path_id", F.nullif("path_up", F.lit(0)).alias("jump"), _own_masks(F.col("local"), pattern).alias("masks")), "path-masks")
    while now.where("jump is not null").limit(1).count():
        above = now.select(F.col("path_id").alias("jump"), F.col("jump").alias("further"), F.col("masks").alias("before"))
        masks = F.when(F.col("before").isNull(), F.col("masks")).otherwise(_composed(F.col("before"), F.col("masks"), states))
        now = stored(now.join(above, "jump", "left").select("path_id", F.col("further").alias("jump"), masks.alias("masks")), "path-masks")
    return now.where(F.getbit(F.col("masks")[0], F.lit(states - 1)) == 1).select("path_id")


def on_paths(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes with one of the paths ``ids``: elements there, and what stands directly in them (tell them apart by ``kind``)."""
    return nodes.join(ids, "path_id", "left_semi")
