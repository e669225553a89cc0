"""Hard negatives by the threshold algorithm.

Vectors are dealt to blocks. A block sorts its rows by each component: the candidate lists. An anchor goes down the lists from
the top where its component is positive and from the bottom where it is negative, scores by random access what it meets and
may be a candidate, and stops when the threshold, the score of what stands at its depth in every list, which no unseen row
exceeds, is strictly below what it still needs: the kth score of the positives, or of each window of negatives. The best of
all blocks are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import stored
from labspark.llm.topk import order_of
from labspark.plans.topn import first_n

#: Rows of a block, and anchors that visit it together, on average.
BLOCK_ROWS = 4096
ANCHOR_ROWS = 1024
#: Rows of each list on the first step down; each further step doubles the depth.
FIRST_DEPTH = 32
#: Whole numbers below this are exact as doubles; sums below the other fit 64 bits.
WHOLE_DOUBLE, WHOLE_64 = 1 << 53, 1 << 63

SCORE = "score long, length int, bytes binary"


def whole(values: pd.Series, scale: int) -> np.ndarray:
    """One row for each vector: the components times ``scale`` rounded down, as 64-bit integers if all are small, else Python's."""
    numbers = np.array(values.tolist(), np.float64).reshape(len(values), -1)
    with np.errstate(over="ignore"):
        down = np.floor(numbers * scale)
    if np.abs(down).max(initial=0) < WHOLE_DOUBLE:
        return down.astype(np.int64)
    out = np.empty(numbers.shape, object)
    for place, value in np.ndenumerate(numbers):
        scaled = value * scale
        out[place] = int(scaled) if abs(scaled) >= WHOLE_DOUBLE and math.isfinite(scaled) else int(value) * scale if not math.isfinite(scaled) else math.floor(scaled)
    return out


def largest(numbers: np.ndarray) -> int:
    return max(int(numbers.max()), -int(numbers.min())) if numbers.size else 0


class Candidates:
    """The rows of a block by rising identifier, and for each dimension the rows by rising component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.largest = largest(self.vectors)
        self.kinds: dict[type, np.ndarray] = {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = self.vectors.astype(kind)
        return self.kinds[kind]

    def descend(self, query: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Step by step the rows met anew, of those ``wanted``, their scores and the threshold; None when all are met."""
        n, most = len(self.ids), len(query) * self.largest * largest(query)
        kind = np.float64 if most < WHOLE_DOUBLE else np.int64 if most < WHOLE_64 else object
        vectors, query = self.of(kind), query.astype(kind)
        used = np.flatnonzero(query)
        if not len(used):
            rows = np.flatnonzero(wanted)
            yield rows, np.array([0] * len(rows), object if kind is object else np.int64), None
            return
        falling, lists = query[used] > 0, self.lists[:, used]
        left, depth = wanted.copy(), 0
        while depth < n:
            stop = min(n, max(FIRST_DEPTH, 2 * depth))
            met = np.zeros(n, bool)
            met[np.where(falling, lists[n - stop : n - depth][::-1], lists[depth:stop]).ravel()] = True
            rows = np.flatnonzero(met & left)
            left[rows] = False
            scores = vectors[rows] @ query[:]
            depth = stop
            last = np.where(falling, lists[n - depth], lists[depth - 1])
            threshold = int(vectors[last, used] @ query[used])
            yield rows, scores if kind is object else scores.astype(np.int64), None if depth == n else threshold

    def best(self, anchor_id: int, label: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and scores of the ``k`` best rows of the anchor's label."""
        rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for new, found, threshold in self.descend(query, (self.labels == label) & (self.ids != anchor_id)):
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, found])
            keep = ranked(rows, scores)[:k]
            rows, scores = rows[keep], scores[keep]
            # An unseen row may tie with the kth and have a smaller identifier, so equality goes on.
            if threshold is not None and len(rows) == k and threshold < scores[-1]:
                break
        return self.ids[rows], scores

    def between(self, anchor_id: int, label: int, query: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest and highest score) identifiers and scores of its ``k`` best rows of other labels."""
        rows, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        rising = scores[0]
        open_ones = [w for w in windows if w[0] <= w[1]]
        lowest = min((low for low, _ in open_ones), default=0)
        for new, found, threshold in self.descend(query, (self.labels != label) & (self.ids != anchor_id)) if open_ones else ():
            # What is below all windows can't be returned.
            new, found = new[found >= lowest], found[found >= lowest]
            rows.append(new)
            scores.append(found)
            rising = np.sort(np.concatenate([rising, found]))
            if threshold is not None and all(done(rising, window, k, threshold) for window in open_ones):
                break
        row, score = np.concatenate(rows), np.concatenate(scores)
        order = ranked(row, score)
        row, score = row[order], score[order]
        out = []
        for low, high in windows:
            some = np.flatnonzero((score >= low) & (score <= high))[:k]
            out.append((self.ids[row[some]], score[some]))
        return out


def ranked(rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places by falling score, then by rising row, that is by rising identifier."""
    falling = -scores if scores.dtype != object else np.unique(-scores, return_inverse=True)[1]
    return np.lexsort((rows, falling))


def done(rising: np.ndarray, window: tuple[int, int], k: int, threshold: int) -> bool:
    """Whether no row at or below the threshold can change the window's ``k`` best."""
    low, high = window
    if threshold < low:
        return True
    below = int(np.searchsorted(rising, high, "right"))
    first = int(np.searchsorted(rising, low, "left"))
    return below - first >= k and threshold < rising[below - k]


def number_of(score: int | None, length: int, data: bytes | None) -> int:
    """The score that ``order_of`` took apart."""
    if length == 0:
        return int(score)
    value = int.from_bytes(data, "big")
    return value if length > 0 else value - ((1 << -8 * length) - 1)


def taking_part(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """``id``, ``label`` (as text), ``v`` (doubles) and its length ``d``, of the rows that have all of them, finite."""

    def bad(x: Column) -> Column:
        number = x.cast("double")
        return x.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))

    good = F.col(vector_column).isNotNull() & ~F.exists(vector_column, bad)
    rows = vectors.where(good & F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    return rows.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"),
        F.size(vector_column).alias("d"),
    )


def block_of(rows: pd.DataFrame, scale: int) -> tuple[Candidates, dict[str, int]]:
    """The block of these rows, each once, and the numbers of its labels."""
    rows = rows.assign(key=[(i, t, tuple(v)) for i, t, v in zip(rows["id"], rows["label"], rows["v"])]).drop_duplicates("key")
    codes, names = pd.factorize(rows["label"])
    return Candidates(rows["id"].to_numpy(np.int64), codes, whole(rows["v"], scale)), {name: i for i, name in enumerate(names)}


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    k: int = 10,
    low: int = 30,
    high: int = 90,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    scale: int = 256,
) -> DataFrame:
    """For each row of ``anchors`` and each of its positives the ``k`` best negatives among ``vectors``.

    Columns: ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``, ``negative_score``. A
    score is the inner product with the anchor of the components times ``scale`` rounded down, exact for components of any
    size; one beyond 64 bits keeps its rank and reads null. Higher scores come first, ties by the smaller identifier. An
    anchor's positives are its ``positives`` best other rows of the same label; the negatives of a positive are rows of other
    labels whose score is at least ``low`` and at most ``high`` percent of the positive's, so a negative score has none.

    Rows without an identifier, a label or a vector, or with a component that is null or not finite, take no part. Vectors
    meet those of their own length. Repeated rows count once; unlike rows that share an identifier are rows, or anchors, of
    their own, and none of them is a candidate of an anchor with that identifier. Anchors without positives or negatives, and
    empty tables, give no rows.

    A group of anchors meets a block in a task of its own, once for the positives and once for the negatives. A task holds one
    of each, however many rows share a label, and only the best for each anchor and block are shuffled after it.
    """
    rows = stored(taking_part(vectors, id_column, vector_column, label_column), "candidates")
    asked = taking_part(anchors, id_column, vector_column, label_column).distinct()
    asked = stored(asked.withColumn("tie", F.xxhash64("label", "v")), "anchors")
    blocks, groups = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-asked.count() // ANCHOR_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    key = ["d", "block", "group"]

    def visited(asking: DataFrame, search: Callable[[Candidates, dict[str, int], pd.DataFrame], Iterator[tuple]], schema: str) -> DataFrame:
        names = [part.split()[0] for part in schema.split(", ")]

        def task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = list(search(*block_of(a, scale), b)) if len(a) and len(b) else []
            out = pd.DataFrame({name: [x[i] for x in found] for i, name in enumerate(names)})
            # As nullable integers from the start: doubles would not hold the scores next to nulls.
            return out.assign(score=pd.array(out["score"], "Int64"))

        every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        spread = asking.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt.withColumn("group", every).groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(task, schema)

    def same_label(block: Candidates, labels: dict[str, int], group: pd.DataFrame) -> Iterator[tuple]:
        for anchor_id, tie, label, query in zip(group["id"], group["tie"], group["label"], whole(group["v"], scale)):
            if label in labels:
                for row, score in zip(*block.best(anchor_id, labels[label], query, positives)):
                    yield anchor_id, tie, row, *order_of(int(score))

    falling = [F.desc("length"), F.desc("bytes"), F.desc("score"), F.asc("row")]
    near = visited(asked, same_label, f"id long, tie long, row long, {SCORE}")
    near = stored(first_n(near, ["id", "tie"], falling, positives, rank="positive"), "positives")
    several = F.sort_array(F.collect_list(F.struct("positive", "row", "score", "length", "bytes")))
    chosen = near.groupBy("id", "tie").agg(several.alias("chosen"))
    asking = asked.join(chosen, ["id", "tie"])

    def other_labels(block: Candidates, labels: dict[str, int], group: pd.DataFrame) -> Iterator[tuple]:
        columns = [group[c] for c in ("id", "tie", "label", "chosen")]
        for anchor_id, tie, label, chosen, query in zip(*columns, whole(group["v"], scale)):
            scores = [number_of(p["score"], p["length"], p["bytes"]) for p in chosen]
            windows = [(-(-low * s // 100), high * s // 100) for s in scores]
            for p, found in zip(chosen, block.between(anchor_id, labels.get(label, -1), query, windows, k)):
                for row, score in zip(*found):
                    yield anchor_id, tie, p["positive"], row, *order_of(int(score))

    negatives = visited(asking, other_labels, f"id long, tie long, positive long, row long, {SCORE}")
    best = first_n(negatives, ["id", "tie", "positive"], falling, k, rank="rank")
    of = near.select("id", "tie", "positive", F.col("row").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(of, ["id", "tie", "positive"]).select(
        F.col("id").alias("anchor_id"),
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("row").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
