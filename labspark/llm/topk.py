"""Exact top-k search by inner product with the threshold algorithm.

Vectors are dealt to blocks. Each block holds, for every dimension, its rows sorted by that component: the lists of the
threshold algorithm. A query goes down the lists that its components choose, from the top where a component is positive and
from the bottom where it is negative, scores what it meets, and stops when the sum of what stands at its depth, which no
unseen row exceeds, is below the kth score. A block's best k go on, and the best of all blocks are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import stored
from labspark.plans.topn import first_n

#: Rows of a block, and queries that visit it together, on average.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
#: Rows of each list that one step goes down.
DEPTH = 64
#: Scores below this fit 64 bits; whole numbers of this size and more are told apart by their doubles.
WHOLE_64, WHOLE_DOUBLE = 1 << 63, float(1 << 53)


def integral(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``id``, ``v`` and ``over``, for vectors that are whole and finite.

    ``v`` has the components times ``scale`` rounded down, as doubles; where that leaves the doubles, it has the component
    alone, and ``over``, else null, says of which components.
    """
    infinite = F.lit(float("inf"))

    def scaled(x: Column) -> Column:
        return x.cast("double") * scale

    def left(x: Column) -> Column:
        return F.abs(scaled(x)) == infinite

    def down(x: Column) -> Column:
        small = F.abs(scaled(x)) < WHOLE_DOUBLE
        return F.when(small, F.floor(scaled(x)).cast("double")).when(left(x), x.cast("double")).otherwise(scaled(x))

    def bad(x: Column) -> Column:
        number = x.cast("double")
        return x.isNull() | F.isnan(number) | (F.abs(number) == infinite)

    good = F.col(vector_column).isNotNull() & ~F.exists(vector_column, bad) & F.col(id_column).isNotNull()
    over = F.when(F.exists(vector_column, left), F.transform(vector_column, left))
    rows = vectors.where(good).select(
        F.col(id_column).cast("bigint").alias("id"), F.transform(vector_column, down).alias("v"), over.alias("over")
    )
    return rows.distinct()


def largest(numbers: np.ndarray) -> int:
    return max(int(numbers.max()), -int(numbers.min())) if numbers.size else 0


class Block:
    """Rows of one block: ids in rising order, their vectors, and for each dimension the rows by rising component.

    Vectors are of 64-bit integers or of Python's. Scores are too: of Python's where 64 bits might not hold them.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.largest = largest(self.vectors)
        self.wide: np.ndarray | None = None

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` rows with the highest scores, ties to the smaller id, the query's own id aside."""
        n = len(self.ids)
        vectors, kind = self.vectors, np.dtype(np.int64)
        if len(query) * self.largest * largest(query) >= WHOLE_64:
            if self.wide is None:
                self.wide = self.vectors.astype(object)
            vectors, kind, query = self.wide, np.dtype(object), query.astype(object)
        used = np.flatnonzero(query)
        down = query[used] > 0
        lists = self.lists[:, used]
        seen = np.zeros(n, bool)
        rows, scores = np.empty(0, np.int64), np.empty(0, kind)
        depth = 0
        while depth < n:
            stop = min(n, depth + DEPTH)
            met = np.where(down, lists[n - stop : n - depth][::-1], lists[depth:stop]).ravel() if len(used) else np.arange(n)
            new = np.zeros(n, bool)
            new[met] = True
            new &= ~seen
            seen |= new
            fresh = np.flatnonzero(new)
            fresh = fresh[self.ids[fresh] != query_id]
            rows = np.concatenate([rows, fresh])
            # Without components there is nothing to sum, and Python's integers would have no zero.
            scores = np.concatenate([scores, vectors[fresh] @ query if len(used) else np.zeros(len(fresh), kind)])
            ranks = -scores if kind != object else np.unique(-scores, return_inverse=True)[1]
            best = np.lexsort((rows, ranks))[:k]
            rows, scores = rows[best], scores[best]
            depth = stop
            if not len(used):
                break
            last = np.where(down, lists[n - depth], lists[depth - 1])
            bound = int(vectors[last, used] @ query[used])
            # A row not yet seen may tie with the kth and have a smaller id, so equality goes on.
            if len(rows) == k and bound < scores[-1]:
                break
        return self.ids[rows], scores


def matrix(values: pd.Series, over: pd.Series, scale: int) -> np.ndarray:
    """One row of integers for each vector: of 64 bits if all fit, else Python's."""
    numbers = np.array(values.tolist(), np.float64).reshape(len(values), -1)
    if over.isna().all() and np.abs(numbers).max(initial=0) < WHOLE_64:
        return numbers.astype(np.int64)
    out = np.empty(numbers.shape, object)
    for i, (row, marks) in enumerate(zip(numbers.tolist(), over.tolist())):
        marks = [False] * len(row) if marks is None else marks
        out[i] = [int(x) * (scale if mark else 1) for x, mark in zip(row, marks)]
    return out


def order_of(score: int) -> tuple[int | None, int, bytes | None]:
    """A score of 64 bits, or none, and two values that order the scores beyond, by their length and then their bytes."""
    if -WHOLE_64 <= score < WHOLE_64:
        return score, 0, None
    n = (abs(score).bit_length() + 7) // 8
    size = abs(score) if score > 0 else (1 << 8 * n) - 1 + score
    return None, n if score > 0 else -n, size.to_bytes(n, "big")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Columns: ``query_id``, ``rank`` from 1, ``id`` and ``score``, the product of the components times ``scale`` rounded
    down, exact for components of any size; a score beyond 64 bits has its right rank and reads null. Ties go to the smaller
    identifier. A row with the query's identifier is no candidate of its. Null vectors, those with null, infinite or
    undefined components, and rows without an identifier take no part. Vectors meet those of their own length. Repeated rows count once; unlike vectors that share an
    identifier are rows, or queries, of their own, and such queries share their ranks. Empty tables give no rows.

    A query block meets each vector block in a task of its own, so a task holds one of each, and only ``k`` rows for each
    query and block are shuffled after it.
    """
    rows = stored(integral(vectors, id_column, vector_column, scale).withColumn("d", F.size("v")), "vectors")
    queries = integral(queries, id_column, vector_column, scale).withColumns({"d": F.size("v"), "tie": F.xxhash64("v", "over")})
    asked = stored(queries, "queries")
    n_rows, n_asked = rows.count(), asked.count()
    blocks, groups = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_asked // QUERY_ROWS))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    key = ["d", "block", "group"]
    dealt = rows.select(*rows.columns, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), numbers(groups).alias("group"))
    spread = asked.select(*asked.columns, F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), numbers(blocks).alias("block"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "tie": [], "id": [], "score": [], "length": [], "bytes": []}
        if len(a) and len(b):
            block = Block(a["id"].to_numpy(np.int64), matrix(a["v"], a["over"], scale))
            for query_id, tie, query in zip(b["id"].tolist(), b["tie"].tolist(), matrix(b["v"], b["over"], scale)):
                ids, scores = block.top(query_id, query, k)
                out["query_id"] += [query_id] * len(ids)
                out["tie"] += [tie] * len(ids)
                out["id"] += ids.tolist()
                for name, values in zip(("score", "length", "bytes"), zip(*map(order_of, scores.tolist()))):
                    out[name] += values
        # As nullable integers from the start: doubles would not hold the scores next to nulls.
        return pd.DataFrame({**out, "score": pd.array(out["score"], "Int64")})

    schema = "query_id long, tie long, id long, score long, length int, bytes binary"
    found = dealt.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(search, schema)
    order = [F.desc("length"), F.desc("bytes"), F.desc("score"), F.asc("id")]
    best = first_n(found, ["query_id", "tie"], order, k, rank="rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def divisible(vectors: DataFrame, id_column: str, n: int) -> DataFrame:
    """A stated query set: the rows whose identifier is divisible by ``n``."""
    return vectors.where(F.pmod(F.col(id_column), F.lit(n)) == 0)
