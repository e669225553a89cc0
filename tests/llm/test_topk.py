from __future__ import annotations

import math
import random

import numpy as np
import pytest

from labspark.llm import topk
from labspark.llm.topk import Block, divisible, top_k


def brute(rows, queries, k):
    def whole(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and whole(v)]
    out = set()
    for q, v in rows:
        if q in queries:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def found(vectors, k=10):
    return {tuple(r) for r in top_k(vectors, divisible(vectors, "vec_id", 10), k).collect()}


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_matches_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(topk, "QUERY_ROWS", block_rows)
    monkeypatch.setattr(topk, "DEPTH", 3)
    rng = random.Random(1)
    # Few values: many ties, and a vector that a third of the rows share.
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5]) for _ in range(6)] if i % 3 else [0.5] * 6) for i in range(200)]
    rows += [(200, None), (210, [1.0, None]), (220, [math.nan] * 6), (230, [math.inf] * 6), (240, []), (250, [0.0] * 6), (260, [0.1, 0.2]), (261, [0.3, 0.1]), (None, [0.5] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(vectors) == brute(rows, set(range(0, 300, 10)), 10)
    assert found(vectors, 3) == brute(rows, set(range(0, 300, 10)), 3)
    assert found(vectors.unionByName(vectors)) == brute(rows, set(range(0, 300, 10)), 10)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_large_components(spark, monkeypatch, block_rows):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(topk, "QUERY_ROWS", block_rows)
    monkeypatch.setattr(topk, "DEPTH", 3)
    rng = random.Random(2)
    # Scores of 64 bits, and far beyond; small vectors among large ones, and ties.
    for sizes in ([1.0, 20_000.0, -3e5], [3e5 + 0.37, 9e5 + 0.71, 3e6], [0.5, 1e9, 3e12, -1e17, 5e37], [1.0, -1e150, 1e306]):
        rows = [(i, [rng.choice(sizes) * rng.choice([1, 1, rng.random()]) for _ in range(4)]) for i in range(60)]
        rows += [(60, [0.0] * 4), (70, [-0.25, 0.0, 0.0, 0.0]), (80, []), (81, []), (90, [max(sizes)]), (91, [1.0])]

        def exact(v):
            # A double beyond 2 ** 53 is whole.
            return [math.floor(1024 * x) if abs(x) < 1e300 else 1024 * int(x) for x in v]

        want = set()
        for q, v in rows[::10] + [r for r in rows[60:] if r[0] % 10 == 0 and r[0] > 60]:
            scores = [(-sum(a * b for a, b in zip(exact(v), exact(w))), i) for i, w in rows if i != q and len(w) == len(v)]
            want |= {(q, n + 1, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(sorted(scores)[:10])}
        assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == want


def test_stops_before_the_end(monkeypatch):
    monkeypatch.setattr(topk, "DEPTH", 8)
    rng = np.random.default_rng(0)
    vectors = rng.integers(-1000, 1000, (3000, 2))
    block = Block(np.arange(3000), vectors)
    scored = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    block.vectors = vectors.view(Counting)
    ids, scores = block.top(-1, np.array([3, -2]), 5)
    exact = vectors @ np.array([3, -2])
    assert scores.tolist() == sorted(exact.tolist(), reverse=True)[:5]
    assert sum(scored) < 1500


def test_empty(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(vectors, vectors).count() == 0
