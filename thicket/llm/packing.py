"""Packing tokenised documents into sequences of a fixed length.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver.
There the configuration linear program (a variable for each way to fill a sequence, a
covering row for each length) is solved approximately by multiplicative weights: a
length's price falls as it gets covered, and an unbounded knapsack by dynamic
programming finds the configurations that are worth most. The solution is rounded to
whole sequences, fractions being carried on to the next configuration, and what is left
over is packed best-fit from the longest, on runs of equal sequences. Prices also give a
lower bound of any packing (their value over what one sequence can hold), which a plan
carries. A plan is a list of (configuration, number of equal sequences), so its size
depends on the lengths, not on the number of documents. A piece's place follows from its
rank among the pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.bpe import ROOM, SLICE, encoder
from thicket.llm.common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

Run = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many a sequence), ...), how many such sequences


class Plan(NamedTuple):
    """``bound``: no packing has fewer sequences. ``by_program``: sequences that come from the linear program."""

    runs: list[Run]
    bound: int
    by_program: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.runs)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, with_ids: bool = False, room: int = ROOM) -> DataFrame:
    """Tokenised pieces of at most ``capacity`` ids (the first of a longer document takes the remainder), stored.

    ``part`` and ``rank`` number the pieces of a length in a partition. ``with_ids`` adds the ids (little-endian 32-bit).
    ``room``: bytes of a worker's memo of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(tokenizer_file, room), TaskContext.get().partitionId(), defaultdict(int)
        end, n = np.array([end_id], "<u4").tobytes(), 8 if with_ids else 7
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                rows: list[list] = [[] for _ in range(n)]
                doc_ids = batch.column(0).slice(k, SLICE).to_pylist()
                for doc_id, raw in zip(doc_ids, coder.encode_all([x or "" for x in batch.column(1).slice(k, SLICE).to_pylist()]), strict=True):
                    ids = raw + end
                    total, at, piece = len(ids) // 4, 0, 0
                    length = total % capacity or capacity
                    while at < total:
                        own = ids[4 * at : 4 * (at + length)]
                        for column, v in zip(rows, (doc_id, piece, at, length, zlib.crc32(own), part, seen[length], own), strict=False):
                            column.append(v)
                        seen[length] += 1
                        at, piece, length = at + length, piece + 1, capacity
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=False)], names=names[:n])

    return stored(docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else "")), "pieces")


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity with unbounded items of length 1.., and the last item used (0: none)."""
    best, item = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = price[1 : c + 1] + best[c - 1 :: -1][:c]
        i = int(value.argmax())
        if value[i] > best[c - 1]:
            best[c], item[c] = value[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, item


def solve(counts: dict[int, int], capacity: int, rounds: int = 300, columns: int = 64, rate: float = 3.0) -> Plan:
    """A plan for ``counts`` (length: how many pieces) with few sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[Run] = []
    if left[capacity]:
        plan.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    demand, size = left.astype(float), np.arange(capacity + 1) / capacity
    have, covered, x = demand > 0, np.zeros(capacity + 1), defaultdict(float)
    whole, bound = sum(n for _, n in plan), float(demand @ size)
    for _ in range(rounds):
        if not have.any() or (covered[have] >= 1).all():
            break
        # Multiplicative weights: exp(-rate * covered), around the prices of the volume bound.
        price = np.where(have & (covered < 1), size * np.exp(-rate * covered / 8), 0.0)
        best, item = knapsack(price, capacity)
        if best[capacity] > 0:
            bound = max(bound, float(demand @ price) / best[capacity])
        gain = np.where(price > 0, price + best[capacity - np.arange(capacity + 1)], -1.0)
        used: set[int] = set()
        for seed in np.argsort(-gain, kind="stable")[:capacity]:
            if len(used) >= columns * 4 or gain[seed] <= 0:
                break
            config, c = defaultdict(int, {int(seed): 1}), capacity - int(seed)
            while c > 0:
                if item[c] == 0:
                    c -= 1
                    continue
                config[int(item[c])] += 1
                c -= int(item[c])
            if used & config.keys():
                continue
            used |= config.keys()
            step = min(demand[i] * (1.0001 - covered[i]) / a for i, a in config.items())  # covers one length to its end
            x[tuple(sorted(config.items(), reverse=True))] += step
            for i, a in config.items():
                covered[i] += a * step / demand[i]
    carried = 0.0
    for config, value in sorted(x.items(), key=lambda kv: (sum(i * a for i, a in kv[0]), kv[1]), reverse=True):
        carried += value
        n = min([int(carried), *(int(left[i]) // a for i, a in config)])
        if n > 0:
            carried -= n
            plan.append((config, n))
            for i, a in config:
                left[i] -= a * n
    by_program = sum(n for _, n in plan) - whole
    return Plan(plan + best_fit(left, capacity), whole + math.ceil(bound - 1e-6), by_program)


def best_fit(left: np.ndarray, capacity: int) -> list[Run]:
    """Best-fit decreasing over a histogram: equal sequences are one run with a number."""
    open_runs: dict[int, list[list]] = defaultdict(list)  # by room: [config, number]
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity) if open_runs.get(r)), None)
            if room is None:
                room, config, number = capacity, {}, n
            else:
                config, number = open_runs[room].pop()
            each = min(room // length, n)
            filled = min(number, n // each)
            open_runs[room - each * length].append([config | {length: each}, filled])
            if room < capacity and number > filled:
                open_runs[room].append([config, number - filled])
            n -= each * filled
    return [(tuple(sorted(config.items(), reverse=True)), number) for runs in open_runs.values() for config, number in runs]


def places(plan: list[Run], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by length and rank: sorted keys (length and first rank), first sequence, pieces a sequence, first offset."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for config, number in plan:
        offset = 0
        for length, each in config:
            rows.append((length << 44 | ranks[length], ranks[length], sequence, each, offset))
            ranks[length] += each * number
            offset += each * length
        sequence += number
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Places stored pieces (see ``pieces``) into sequences; adds ``sequence_id`` and ``offset``.

    Every piece of ``cut`` is placed once, in no more than ``capacity``; offsets have no gaps from 0.
    An empty table packs into no sequence. Repeated or null ``doc_id`` are documents like any other.
    """
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = stored(counts, "piece-counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # <= capacity rows
    keys, first_rank, first_sequence, each, first_offset = places(solve(histogram, capacity).runs, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    # Partitions times lengths: it grows with the input, so it is not broadcast. A key has a partition's pieces at most.
    base = counts.select("part", "length", before.alias("before")).hint("shuffle_hash")
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth = rank - first_rank[k]
            sequence, offset = first_sequence[k] + nth // each[k], first_offset[k] + nth % each[k] * length
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PACKED)
