"""Hard negatives against brute force with whole numbers."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from labspark.llm import hard_negatives as module
from labspark.llm.hard_negatives import Candidates, hard_negatives, number_of
from labspark.llm.topk import order_of

TABLE = "vec_id long, embedding array<double>, label int"


def brute(rows, anchors, positives=5, k=10, low=30, high=90, scale=256):
    def good(r):
        return None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[1])

    def down(v):
        return [math.floor(Fraction(x) * scale) for x in v]

    rows = {(i, label, tuple(v)): down(v) for i, v, label in filter(good, rows)}
    out = []
    for anchor in {(i, label, tuple(v)): down(v) for i, v, label in filter(good, anchors)}.items():
        (i, label, v), q = anchor
        scored = [(sum(a * b for a, b in zip(q, w)), r[0], r[1]) for r, w in rows.items() if r[0] != i and len(w) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, pid, _ in [s for s in scored if s[2] == label][:positives]:
            some = [s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps][:k]
            out += [(i, pid, n, nid, long(ps), long(ns)) for n, (ns, nid, _) in enumerate(some, 1)]
    return sorted(out, key=repr)


def long(score):
    return score if -(1 << 63) <= score < 1 << 63 else None


def random_rows(seed, n=300, d=8, labels=3, rough=4):
    rng = np.random.default_rng(seed)
    # Few values, so that scores tie.
    return [(i, [float(x) for x in rng.integers(-rough, rough + 1, d) / 8], int(rng.integers(labels))) for i in range(n)]


def compare(spark, rows, every=10, **params):
    table = spark.createDataFrame(rows, TABLE)
    found = hard_negatives(table, table.where(f"vec_id % {every} = 0"), **params).collect()
    want = brute(rows, [r for r in rows if r[0] is not None and r[0] % every == 0], **params)
    assert sorted(map(tuple, found), key=repr) == want
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_and_groups(spark, seed, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 70)
    monkeypatch.setattr(module, "ANCHOR_ROWS", 8)
    assert compare(spark, random_rows(seed))


def test_one_label_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 64)
    rows = [(i, v, 0 if i % 5 else label) for i, v, label in random_rows(3)]
    assert compare(spark, rows, positives=2, k=3)


def test_few_candidates_ties_and_no_scores(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(8)] + [(20, [0.0, 0.0], 0), (30, [-1.0, 1.0], 9)]
    compare(spark, rows)
    assert compare(spark, rows, low=0, high=100)


def test_scores_of_any_size(spark):
    """Beyond doubles' whole numbers, beyond 64 bits and at the end of the doubles."""
    rows = [(i, [float(x) * s for x in v], label) for s in (1.0,) for i, v, label in random_rows(4, 40, 3)]
    rows += [(100 + i, [x * 3e15 for x in v], label) for i, v, label in rows[:40]]
    rows += [(200 + i, [x * 1e30 for x in v], label) for i, v, label in rows[:10]]
    rows += [(300, [1e308, 1.0, -2.0], 0), (301, [1.5e308, 0.0, 0.25], 0), (302, [0.9e308, 3.0, 1.0], 1)]
    want = compare(spark, rows)
    assert any(w[4] is None for w in want) and any(w[4] is not None for w in want)


def test_odd_rows(spark):
    """Nulls in every column, not finite components, other lengths, repeated rows, shared identifiers, clashing names."""
    rows = random_rows(5, 60, 4)
    rows += [rows[3], rows[10], (10, [0.5, 0.5, 0.5, 0.5], 2), (11, [0.5, 0.5, 0.5, 0.25], 1)]
    rows += [(61, None, 1), (None, [1.0] * 4, 1), (62, [1.0] * 4, None), (63, [1.0, None, 1.0, 1.0], 1)]
    rows += [(64, [float("nan"), 1.0, 1.0, 1.0], 1), (65, [float("inf"), 1.0, 1.0, 1.0], 2), (70, [1.0, 2.0], 1), (71, [1.0, 1.0], 0), (72, [1.0, 1.5], 1), (73, [], 1)]
    compare(spark, rows)
    table = spark.createDataFrame(rows, TABLE)
    clash = table
    for name in ("id", "tie", "block", "group", "d", "v", "row", "positive", "rank", "score"):
        clash = clash.withColumn(name, clash.vec_id)
    found = [tuple(r) for r in hard_negatives(clash, clash.where("vec_id % 10 = 0")).collect()]
    assert sorted(found, key=repr) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0])


def test_empty_tables(spark):
    table = spark.createDataFrame(random_rows(6, 20), TABLE)
    none = table.limit(0)
    assert hard_negatives(none, none).count() == hard_negatives(table, none).count() == hard_negatives(none, table).count() == 0


def test_the_descent_stops_early_and_stays_right():
    """An anchor whose best rows lead its lists stops after a few steps; what is unread can't matter."""
    rng = np.random.default_rng(7)
    vectors = rng.integers(-40, 40, (3000, 4))
    vectors[:30] = [300, 300, 300, 300] + rng.integers(0, 9, (30, 4))
    labels = np.arange(3000) % 2
    block = Candidates(np.arange(3000), labels, vectors)
    read = []
    descend = Candidates.descend

    def counted(self, query, wanted):
        for step in descend(self, query, wanted):
            read.append(len(step[0]))
            yield step

    query = np.array([5, 5, 5, 5])
    try:
        Candidates.descend = counted
        ids, scores = block.best(-1, 0, query, 5)
    finally:
        Candidates.descend = descend
    order = np.lexsort((np.arange(3000), -(vectors @ query)))
    assert ids.tolist() == [i for i in order if labels[i] == 0][:5]
    assert scores.tolist() == [int(vectors[i] @ query) for i in ids]
    assert sum(read) < 1500 / 5


def test_scores_are_put_together_again():
    for score in (0, -1, (1 << 63) - 1, -(1 << 63), 1 << 63, -(1 << 63) - 1, 3 << 200, -(5 << 99)):
        assert number_of(*order_of(score)) == score
