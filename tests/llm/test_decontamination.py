"""Benchmark runs in documents against brute force over words."""

from __future__ import annotations

import random
import re

import pytest

from labspark.llm import decontamination
from labspark.llm.decontamination import SPAN, benchmark_hits
from tests.llm.conftest import ODD_TEXTS

SPLIT = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPLIT.split(lowered) if w]


def brute(texts, items, span=SPAN):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, named = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    hit.update(range(p, p + n))
                    named |= found
        out.append((len(w), sorted(hit), sorted(named)))
    return out


def covered(spans):
    return [i for s in spans for i in range(s.start, s.end)]


def compare(spark, docs_of, texts, items, **params):
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = benchmark_hits(docs_of(texts), table, **params).collect()
    found = {r.id: (r.n_words, covered(r.spans), r["items"]) for r in rows}
    assert len(rows) == len(texts)
    for row in rows:
        assert all(a.end < b.start for a, b in zip(row.spans, row.spans[1:]))
    want = brute(texts, items, params.get("span", SPAN))
    assert {i: w for i, w in enumerate(want) if found[i] != w} == {}
    return want


def planted(seed, n_items=12, n_docs=40, vocabulary=30):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["Über", "日本", "X9"]
    items = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 9, 10, 11, 14, 40]))) for _ in range(n_items)]
    texts = []
    for _ in range(n_docs):
        parts = []
        for _ in range(rng.randrange(4)):
            w = rng.choice(items).split()
            a = rng.randrange(len(w))
            piece = w[a : a + rng.choice([4, 9, 10, 11, 30])]
            parts += rng.choices(vocab, k=rng.randrange(12)) + [p.upper() if rng.random() < 0.3 and p.isascii() else p for p in piece]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return texts, list(enumerate(items))


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_are_those_of_all_windows(spark, docs_of, seed):
    texts, items = planted(seed)
    want = compare(spark, docs_of, texts, items)
    assert any(hit for _, hit, _ in want) and any(not hit for _, hit, _ in want)


def test_only_long_items(spark, docs_of):
    texts, items = planted(3)
    items = [(i, t) for i, t in items if len(words(t)) >= SPAN]
    compare(spark, docs_of, texts, items)


def test_every_shared_run_of_the_span_is_met(spark, docs_of):
    """Runs of exactly the span at every offset, with the sieve as small as it gets, in repeated words as well."""
    rng = random.Random(4)
    item = [f"a{i}" for i in range(60)]
    texts = [" ".join([*rng.choices("xyz", k=rng.randrange(9)), *item[p : p + SPAN], *rng.choices("xyz", k=5)]) for p in range(51)]
    texts += [" ".join(item[p : p + SPAN - 1]) for p in range(51)]
    want = compare(spark, docs_of, texts, [(7, " ".join(item)), (8, "same " * 25), (9, "same " * 12 + "end")])
    assert [len(hit) for _, hit, _ in want] == [SPAN] * 51 + [0] * 51


def test_repeats_and_ties(spark, docs_of):
    texts = ["same " * 3000, "same " * 9, "same " * 10 + "end", "no " + "ab " * 400 + "cd " * 12, "ab cd " * 50]
    compare(spark, docs_of, texts, [(1, "same " * 11), (1, "ab cd " * 6), (2, "same " * 10 + "end"), (3, "ab cd " * 6)])


def test_a_saturated_sieve_changes_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontamination, "SIEVE_LARGEST", 64)
    compare(spark, docs_of, *planted(5))


def test_odd_rows(spark, odd, odd_rows):
    """Nulls, empty and long texts, a repeated row and extra columns with clashing names; no items give no hits."""
    clash = odd
    for name in ("pos", "hash", "left", "right", "place", "item", "found", "spans", "w"):
        clash = clash.withColumn(name, clash.doc_id)
    items = [(1, "word " * 12), (2, None), (3, ""), (4, "...")]
    table = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, row int, hash string")
    rows = benchmark_hits(clash, table).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, *w) for i, w in zip([r[0] for r in odd_rows], brute([r[1] for r in odd_rows], items))]
    assert sorted([(r.id, r.n_words, covered(r.spans), r["items"]) for r in rows], key=key) == sorted(want, key=key)
    assert len(ODD_TEXTS) + 2 == len(rows)
    assert all(not r.spans and not r["items"] for r in benchmark_hits(odd, table.limit(0)).collect())


def test_empty_tables(spark, empty):
    assert benchmark_hits(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_other_lengths(spark, docs_of):
    texts, items = planted(6)
    compare(spark, docs_of, texts, items, span=7, gram=3)
