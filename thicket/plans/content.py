"""Content models as automata: built from functions, run over node tables in one sorted pass and over parse events as they arrive.

A model's positions (its names, copies of repeated parts apart) give a table of states by the subset construction; all models
share one numbering of states, so an open element is one integer.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.sources.shred import ELEMENT
from thicket.sources.store import stored
from thicket.streaming.push import _pushed

#: States that no model numbers: anything goes; a child came that can't stand there.
ANY, DEAD = 0, 1
Model = tuple

UNEXPECTED, INCOMPLETE, UNDECLARED = "unexpected", "incomplete", "undeclared"


def name(local: str) -> Model:
    """One child element of a name."""
    return ("name", local)


def sequence(*parts: Model) -> Model:
    """The parts one after the other; without any, the element is empty."""
    return ("sequence", *parts)


def choice(*parts: Model) -> Model:
    """One of the parts."""
    return ("choice", *parts)


def repeated(part: Model, low: int = 0, high: int | None = None) -> Model:
    """``low`` to ``high`` times the part (without a ``high``, any number)."""
    if low < 0 or (high is not None and high < low):
        raise ValueError(f"{low} to {high} times")
    return ("repeated", part, low, high)


class Positions:
    """Positions of a model: their names, the part of the model each is a copy of, and what may follow each."""

    def __init__(self, model: Model, limit: int) -> None:
        self.limit, self.names, self.source, self.follow = limit, [], [], []
        self.nullable, self.first, self.last = self._add(model, ())

    def _chain(self, a: tuple, b: tuple) -> tuple:
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def _add(self, model: Model, at: tuple) -> tuple[bool, frozenset, frozenset]:
        """(whether it may be empty, first positions, last positions)"""
        kind, *parts = model
        if kind == "name":
            if len(self.names) == self.limit:
                raise ValueError(f"a content model has more than {self.limit} positions")
            self.names.append(parts[0])
            self.source.append(at)
            self.follow.append(frozenset())
            only = frozenset([len(self.names) - 1])
            return False, only, only
        if kind == "choice":
            seen = [self._add(p, (*at, i)) for i, p in enumerate(parts)]
            return any(s[0] for s in seen), frozenset().union(*(s[1] for s in seen)), frozenset().union(*(s[2] for s in seen))
        empty = (True, frozenset(), frozenset())
        if kind == "sequence":
            whole = empty
            for i, p in enumerate(parts):
                whole = self._chain(whole, self._add(p, (*at, i)))
            return whole
        part, low, high = parts
        if high == 0:
            return empty
        # Copies from the last to the first; those beyond ``low`` may be left out together with all after them.
        tail = None
        for k in reversed(range(max(low, 1) if high is None else high)):
            copy = self._add(part, (*at, 0))
            if tail is None and high is None:
                for p in copy[2]:
                    self.follow[p] |= copy[1]
            tail = copy if tail is None else self._chain(copy, tail)
            if k >= low:
                tail = (True, *tail[1:])
        return tail


def ambiguous(model: Model, limit: int = 10_000) -> list[str]:
    """Names for which a model doesn't say which of its parts an element belongs to without looking ahead (such models are run all the same)."""
    p = Positions(model, limit)
    found = set()
    for together in (p.first, *p.follow):
        sources: dict[str, tuple] = {}
        for q in together:
            if sources.setdefault(p.names[q], p.source[q]) != p.source[q]:
                found.add(p.names[q])
    return sorted(found)


class Automata:
    """States of the content models of elements by local name. Counts are unrolled: a model of over ``limit`` positions or states raises ``ValueError``."""

    def __init__(self, models: Mapping[str, Model | None], limit: int = 10_000) -> None:
        """``models``: a model, or None where anything may stand, for each local name."""
        self.next: dict[int, dict[str, int]] = {}
        self.start: dict[str, int] = {}
        self.unfinished: set[int] = set()
        self.n = 2
        for local, model in models.items():
            self.start[local] = ANY if model is None else self._number(Positions(model, limit), limit)

    def _number(self, p: Positions, limit: int) -> int:
        numbers: dict[frozenset | None, int] = {None: self.n}
        todo: list[frozenset | None] = [None]
        while todo:
            here = todo.pop()
            onward: dict[str, set] = {}
            for q in p.first if here is None else frozenset().union(*(p.follow[q] for q in here)):
                onward.setdefault(p.names[q], set()).add(q)
            moves = self.next[numbers[here]] = {}
            for local, found in onward.items():
                there = frozenset(found)
                if there not in numbers:
                    if len(numbers) == limit:
                        raise ValueError(f"a content model has more than {limit} states")
                    numbers[there] = self.n + len(numbers)
                    todo.append(there)
                moves[local] = numbers[there]
            if not (p.nullable if here is None else here & p.last):
                self.unfinished.add(numbers[here])
        start, self.n = self.n, self.n + len(numbers)
        return start

    def after(self, state: int, local: str) -> int:
        return state if state in (ANY, DEAD) else self.next[state].get(local, DEAD)


def _runs(automata: Automata):
    """Folds rows sorted by parent, an element's own row (``pre`` -1) before those of its children.

    Only a partition's first parent can have begun in the one before, and its last go on in the next: these give parts, the
    first with its end for each state it might start in.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, local, state, bad, out = None, 0, None, ANY, None, []
        frame = lambda: pd.DataFrame(out, columns=_COLUMNS).astype({"state": "Int32", "bad": "Int64"})
        now, bads, first = None, None, True

        def close(last: bool) -> None:
            if now is not None:
                out.append((*key, part, None, None, list(now), list(bads), None))
            elif last:
                out.append((*key, part, state, bad, None, None, local))
            elif state == DEAD or state in automata.unfinished:
                out.append((*key, part, state, bad, [], [], local))

        for batch in batches:
            for part_, doc, ctx, pre, child in batch[["part", "doc_id", "ctx", "pre", "local"]].itertuples(index=False):
                if key != (doc, ctx):
                    if key is not None:
                        close(False)
                    part, key, local, state, bad, now, bads = part_, (doc, ctx), None, ANY, None, None, None
                    if first and pre >= 0:
                        now, bads = list(range(automata.n)), [None] * automata.n
                    first = False
                if pre < 0:
                    local, state = child, automata.start.get(child, ANY)
                    if child not in automata.start:
                        out.append((*key, part, ANY, None, [], [], child))
                elif now is None:
                    to = automata.after(state, child)
                    bad = int(pre) if to == DEAD != state else bad
                    state = to
                else:
                    moved = {s: automata.after(s, child) for s in set(now)}
                    bads = [int(pre) if moved[s] == DEAD != s else b for s, b in zip(now, bads)]
                    now = [moved[s] for s in now]
            if len(out) > 10_000:
                yield frame()
                out = []
        if key is not None:
            close(True)
        yield frame()

    return fold


_COLUMNS = ["doc_id", "ctx", "part", "state", "bad", "states", "bads", "local"]


def content_violations(nodes: DataFrame, automata: Automata) -> DataFrame:
    """Elements whose children don't match their models: ``doc_id``, ``pre``, ``local``, ``violation``, ``at``.

    ``unexpected``: ``at`` is the ``pre`` of the first child that can't stand there; ``incomplete``: children are missing at the end;
    ``undeclared``: no model has the element's name (its children are free). Names are local ones, text isn't looked at; no nodes give no rows.

    ``nodes`` should be stored ones: the ranges are found by a sample, for which they are read once more. One range shuffle by parent, no join: a parent with any number of children is read by many tasks, and no task holds more of it than a
    state. Those cut by a partition's border, two a partition at most, are put together from their parts.
    """
    elements = nodes.where((F.col("kind") == ELEMENT) & F.col("doc_id").isNotNull())
    row = lambda ctx, pre: F.struct(F.col(ctx).cast("long").alias("ctx"), pre.cast("long").alias("pre"))
    both = elements.select("doc_id", "local", F.inline(F.array(row("pre", F.lit(-1)), row("parent", F.col("pre")))))
    both = both.where("ctx is not null").repartitionByRange("doc_id", "ctx", "pre").sortWithinPartitions("doc_id", "ctx", "pre")
    schema = f"doc_id {nodes.schema['doc_id'].dataType.simpleString()}, ctx long, part int, state int, bad long, states array<int>, bads array<long>, local string"
    runs = stored(both.withColumn("part", F.spark_partition_id()).mapInPandas(_runs(automata), schema), "content-runs")
    at_once = runs.where("local is not null and size(states) = 0").select("doc_id", "ctx", "local", "state", "bad")
    parts = F.array_sort(F.collect_list(F.struct("part", "state", "bad", "states", "bads")))
    begun = F.lit(None).cast("struct<state:int,bad:bigint>")
    go_on = lambda a, p: F.when(a.isNotNull(), F.struct(p["states"][a["state"]].alias("state"), F.coalesce(a["bad"], p["bads"][a["state"]]).alias("bad")))
    fold = F.aggregate(parts, begun, lambda a, p: F.when(p["states"].isNull(), F.struct(p["state"], p["bad"])).otherwise(go_on(a, p)))
    torn = runs.where("states is null or size(states) > 0").groupBy("doc_id", "ctx").agg(F.max("local").alias("local"), fold.alias("f"))
    found = at_once.union(torn.where("local is not null").select("doc_id", "ctx", "local", "f.state", "f.bad"))
    unfinished = F.array(*(F.lit(s) for s in sorted(automata.unfinished))) if automata.unfinished else F.array().cast("array<int>")
    known = F.array(*(F.lit(n) for n in automata.start)) if automata.start else F.array().cast("array<string>")
    verdict = F.when(F.col("state") == DEAD, UNEXPECTED).when(F.array_contains(unfinished, F.col("state")), INCOMPLETE).when(~F.array_contains(known, F.col("local")), UNDECLARED)
    return found.select("doc_id", F.col("ctx").alias("pre"), "local", verdict.alias("violation"), F.col("bad").alias("at")).where("violation is not null").distinct()


def push_violations(chunks: DataFrame, automata: Automata) -> DataFrame:
    """The same violations, from a stream of chunks as of ``streaming.push.push_events``, each as soon as it is certain: ``doc_id``, ``seq`` (of the child's start, or the element's end or start), ``local``, ``violation``, ``depth``.

    The state of a document is one integer for each open element. An element that its document ends in is not incomplete, but an error of the parser's.
    """
    names: dict[int, str] = {}
    for local, start in automata.start.items():
        names |= {s: local for s in _reached(automata, start)}

    def rows_of(rows: list[tuple], states: list[int]) -> list[tuple]:
        out = []
        for seq, event, tag, _, depth, _ in rows:
            if event == "start":
                local = tag.rpartition(":")[2]
                if states and states[-1] not in (ANY, DEAD):
                    to = automata.after(states[-1], local)
                    if to == DEAD:
                        out.append((seq, names[states[-1]], UNEXPECTED, depth - 1))
                    states[-1] = to
                if local not in automata.start:
                    out.append((seq, local, UNDECLARED, depth))
                states.append(automata.start.get(local, ANY))
            elif event == "end":
                state = states.pop()
                if state in automata.unfinished:
                    out.append((seq, names[state], INCOMPLETE, depth))
        return out

    return _pushed(chunks, "doc_id long, seq long, local string, violation string, depth int", rows_of)


def _reached(automata: Automata, start: int) -> set[int]:
    seen, todo = {start} - {ANY}, [start]
    while todo:
        for s in automata.next.get(todo.pop(), {}).values():
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return seen
