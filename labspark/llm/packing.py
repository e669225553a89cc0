"""Packing documents into sequences of a fixed length by linear grouping.

What decides a packing is how many items there are of each length. That table has at most ``capacity`` rows whatever the
input; it alone reaches the driver, and the plan made from it speaks of runs of items of one length. Its size depends on
the lengths, not on the number of items. Executors number the items of each length and look their places up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labspark.llm import tokens
from labspark.llm.common import stored

#: Groups of equal cardinality that large items are rounded up in.
GROUPS = 64
#: Parts of the capacity that large items exceed. Each gives a plan, and the one with the fewest bins is taken.
SMALL = (1 / 2, 1 / 3, 1 / 4)
#: Items of one length and cell that one task numbers, on average.
CELL_ROWS = 2000


class Run(NamedTuple):
    """``n`` items of one length, from number ``first``: ``each`` to a bin, from bin ``bin`` on, behind ``offset``."""

    length: int
    first: int
    n: int
    each: int
    bin: int
    offset: int


class Bins(NamedTuple):
    """``n`` bins from ``first`` on, each filled up to ``used``."""

    first: int
    n: int
    used: int


def best_fill(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size to put into one bin for the largest value: the unbounded knapsack, exactly."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (size, value) in enumerate(zip(sizes.tolist(), values.tolist())):
        if value <= 0:
            continue
        for start in range(size, capacity + 1, size):
            here = slice(start, min(start + size, capacity + 1))
            other = best[start - size : here.stop - size] + value
            better = other > best[here]
            best[here][better] = other[better]
            choice[here][better] = i
    counts, left = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    while left > 0 and choice[left] >= 0:
        counts[choice[left]] += 1
        left -= int(sizes[choice[left]])
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of a few sizes and how often to use each, by the linear program of cutting stock, rounded down.

    Columns are made as they are needed: the knapsack finds the one of the least reduced cost. What rounding leaves of the
    demand stays for the caller. Any stop gives a valid answer.
    """
    columns = [np.eye(len(sizes), dtype=np.int64)[i] * (capacity // s) for i, s in enumerate(sizes.tolist())]
    inverse = np.diag([1 / c[i] for i, c in enumerate(columns)])
    for _ in range(40 * len(sizes)):
        prices = inverse.sum(axis=0)
        column = best_fill(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-9:
            break
        amounts, step = inverse @ demand, inverse @ column
        ratio = np.where(step > 1e-12, amounts / np.where(step > 1e-12, step, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[out] = column
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    times = np.floor(inverse @ demand + 1e-9).astype(np.int64)
    chosen, left = [], demand.copy()
    for column, n in zip(columns, times.tolist()):
        used = column[column > 0]
        n = min([max(0, n), *(left[column > 0] // used).tolist()])
        if n:
            left -= n * column
            chosen.append((column, n))
    return chosen


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> list[Run]:
    """Places for ``counts[length]`` items of each length from 1 to ``capacity``, in as few bins as this finds."""
    plans = (_plan(counts, capacity, groups, part) for part in small)
    return min(plans, key=lambda runs: max((r.bin - (-r.n // r.each) for r in runs), default=0))


def _plan(counts: dict[int, int], capacity: int, groups: int, small: float) -> list[Run]:
    """Group the items above ``small`` of the capacity and round them up, choose configurations, substitute, fill up."""
    runs: list[Run] = []
    free: dict[int, list[Bins]] = {}
    opened = counts.get(capacity, 0)
    if opened:
        runs.append(Run(capacity, 0, opened, 1, 0, 0))
    # The large items, longest first, in groups of one cardinality; a length may lie in several groups.
    lengths = sorted((n for n in counts if counts[n] and n < capacity), reverse=True)
    large = [n for n in lengths if n > capacity * small]
    total = sum(counts[n] for n in large)
    rest: list[list[int]] = []
    members: dict[int, list[list[int]]] = {}
    if total:
        room, size = 0, 0
        for length in large:
            first, left = 0, counts[length]
            while left:
                if not room:
                    room, size = -(-total // groups), length
                taken = min(room, left)
                members.setdefault(size, []).append([length, first, taken])
                first, left, room = first + taken, left - taken, room - taken
        sizes = np.array(sorted(members, reverse=True))
        demand = np.array([sum(m[2] for m in members[s]) for s in sizes.tolist()])
        for column, n in configurations(sizes, demand, capacity):
            bins = [Bins(opened, n, 0)]
            opened += n
            for size in np.repeat(sizes, column).tolist():
                bins = _substituted(bins, members[size], runs)
            for b in bins:
                free.setdefault(capacity - b.used, []).append(b)
        rest = [m for size in sizes.tolist() for m in members[size] if m[2]]
    rest += [[n, 0, counts[n]] for n in lengths if n <= capacity * small]
    _best_fit(rest, free, opened, capacity, runs)
    return runs


def _substituted(bins: list[Bins], members: list[list[int]], runs: list[Run]) -> list[Bins]:
    """Give each bin the next of a group's actual items; bins part where the length changes."""
    out = []
    for first, n, used in bins:
        while n:
            length, number, left = members[0]
            taken = min(n, left)
            runs.append(Run(length, number, taken, 1, first, used))
            out.append(Bins(first, taken, used + length))
            first, n = first + taken, n - taken
            members[0][1:] = [number + taken, left - taken]
            if left == taken:
                members.pop(0)
    return out


def _best_fit(rest: list[list[int]], free: dict[int, list[Bins]], opened: int, capacity: int, runs: list[Run]) -> None:
    """Put items, longest first, each into the bin with the least room that takes it, else into a new one."""
    has_room = np.zeros(capacity + 1, bool)
    has_room[[r for r in free if free[r]]] = True
    for length, first, n in sorted(rest, reverse=True):
        while n:
            fits = has_room[length:]
            room = length + int(np.argmax(fits))
            if fits.any():
                bins = free[room].pop()
            else:
                room, bins = capacity, Bins(opened, -(-n // (capacity // length)), 0)
                opened += bins.n
            each = min(room // length, n)
            filled = min(bins.n, n // each)
            runs.append(Run(length, first, filled * each, each, bins.first, bins.used))
            first, n = first + filled * each, n - filled * each
            after = [Bins(bins.first, filled, bins.used + each * length)]
            if bins.n > filled:
                after.append(Bins(bins.first + filled, bins.n - filled, bins.used))
            for b in after:
                free.setdefault(capacity - b.used, []).append(b)
            for changed in (room, *(capacity - b.used for b in after)):
                has_room[changed] = bool(free.get(changed))


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1
) -> DataFrame:
    """The pieces of each document: ``id``, ``piece``, ``start``, ``length`` and ``ids_crc32``.

    A document is its token ids and ``end_id``. Only documents longer than ``capacity`` are cut, into pieces of that
    length and a last one that may be shorter. A null text is empty and has one piece of length 1.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for i, ids in enumerate(tokens.encoded(batch, "text", tokenizer, end_id)):
                wide = ids.astype("<u4")
                for piece, start in enumerate(range(0, len(wide), capacity)):
                    part = wide[start : start + capacity]
                    for column, value in zip(out, (i, piece, start, len(part), zlib.crc32(part.tobytes()))):
                        out[column].append(value)
            if out["row"]:
                taken = batch.column("id").take(pa.array(out.pop("row")))
                arrays = [taken, pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in list(out)[1:])]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *out])

    return rows.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def numbered(items: DataFrame, length: str, counts: dict[int, int], ties: list[str]) -> DataFrame:
    """Add ``_number``: 0, 1, ... among the items of one length, which may be a third of all.

    Items of one length lie in cells, by a hash; a cell begins where those before it end. The number of cells follows from
    the number of items, by one rule for every length.
    """
    spark = items.sparkSession
    cells = spark.createDataFrame([(n, -(-c // CELL_ROWS)) for n, c in counts.items()], "_length long, _cells long")
    dealt = items.join(F.broadcast(cells), F.col(length) == F.col("_length")).withColumn(
        "_cell", F.pmod(F.xxhash64(*ties), F.col("_cells"))
    )
    sums = dealt.groupBy("_length", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("_length", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_length", "_cell").orderBy(*ties))
    joined = dealt.join(begins, ["_length", "_cell"]).withColumn("_number", F.col("_begin") + inside - 1)
    return joined.select(*items.columns, "_number")


def packed(
    items: DataFrame, length: str, capacity: int, ties: list[str], groups: int = GROUPS, small: tuple[float, ...] = SMALL
) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: places in sequences of at most ``capacity``, without gaps.

    ``items`` is stored data: it is read several times. Lengths run from 1 to ``capacity``. Items equal in length are
    interchangeable; ``ties`` are the columns that order them. An empty table gives no rows.
    """
    counts = {int(r[0]): int(r[1]) for r in items.groupBy(length).count().collect()}
    runs = np.array(sorted(plan(counts, capacity, groups, small)), np.int64).reshape(-1, len(Run._fields))
    keys = runs[:, 0] << 44 | runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        of, number = lengths.to_numpy(np.int64), numbers.to_numpy(np.int64)
        found = runs[np.searchsorted(keys, of << 44 | number, "right") - 1]
        inside = number - found[:, 1]
        bins = found[:, 4] + inside // found[:, 3]
        return pd.DataFrame({"sequence_id": bins, "offset": found[:, 5] + inside % found[:, 3] * of})

    placed = numbered(items, length, counts, ties).withColumn("_place", place(F.col(length), F.col("_number")))
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    return placed.select(*kept, "_place.sequence_id", "_place.offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1
) -> DataFrame:
    """The pieces of all documents, as in ``token_pieces``, with their places, as in ``packed``.

    Repeated rows are packed as often as they occur.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, id_column, text_column, end_id), "pieces")
    return packed(pieces, "length", capacity, ["id", "piece", "ids_crc32"])
