from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labspark.llm import mixing
from labspark.llm.mixing import mix, mix_counts, mixed_documents, schedule, source_targets


def test_targets():
    assert source_targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    # The first stops at three times its source; the rest go to the others, 2 to 1.
    assert source_targets([10, 100, 100]) == pytest.approx([30, 120, 60])
    assert source_targets([]) == []
    assert source_targets([0, 0]) == [0, 0]
    assert source_targets([0, 5]) == [0, 5]
    for sizes in ([1, 1000, 3, 0, 50, 700, 2], [7] * 20):
        targets = source_targets(sizes)
        assert sum(targets) == pytest.approx(sum(sizes))
        assert all(t <= 3 * s + 1e-9 for t, s in zip(targets, sizes))


def check(rows, texts, sources):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    of_source = Counter()
    for i, s in sources.items():
        of_source[s] += size[i]
    taken = Counter()
    for r in rows:
        assert (r.size, r.source_size) == (size[r.id], of_source[sources[r.id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[sources[r.id]] += r.taken
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, source_targets([of_source[s] for s in order])))
    assert {sources[r.id]: r.target for r in rows} == pytest.approx(targets)
    for s in order:
        assert abs(taken[s] - targets[s]) <= 1


def test_counts(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 30, 200, 3000]), rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(400)]
    rows.append((400, None, "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts, sources = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    found = mix_counts(docs).collect()
    assert len(found) == len(rows)
    check(found, texts, sources)
    again = mix_counts(docs.repartition(7)).collect()
    assert {r.id: r.taken for r in again} == {r.id: r.taken for r in found}


def test_the_mix_itself(spark):
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(200)]
    _, mixed = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16)
    parts = mixed.collect()
    slots = Counter()
    for p in parts:
        slots[p.slot] += p.words
    assert max(slots.values()) == 16
    # Any stretch of the mix has its sources near 5 to 2.
    number = {p.slot: p.number for p in parts}
    for start in range(0, 500, 50):
        share = sum(number.get(s, 1) == 0 for s in range(start, start + 50)) / 50
        assert abs(share - 5 / 7) < 0.06


def test_ranks_are_gapless(spark):
    sources = [(0, "a", 10, 60_000.0, 1), (1, "b", 10, 0.0, 1), (2, "c", 10, 3_000.0, 1)]
    rows = schedule(spark, sources, 8).collect()
    for number in (0, 1, 2):
        ranks = [r.rank for r in sorted(rows, key=lambda r: r.slot) if r.number == number]
        assert ranks == list(range(len(ranks)))
    assert not any(r.number == 1 for r in rows)


def test_small_sources_get_all_their_words(spark):
    rng = random.Random(2)
    rows = [(i, "w " * 20_000, f"big{i}") for i in range(2)]
    rows += [(i, "w " * rng.randrange(1, 7), f"small{i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mix_counts(docs, block_words=1).collect(), {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows})
    # As large as 40 million words: each source has every block, and no slot is named twice.
    sources = [(i, str(i), 10, t, 1) for i, t in enumerate([2.5e7, 1.5e7, *(rng.uniform(1, 2000) for _ in range(40))])]
    slots = schedule(spark, sources, 256)
    assert slots.count() == slots.select("slot").distinct().count()
    ranks = {r.number: (r.n, r.last) for r in slots.groupBy("number").agg(F.countDistinct("rank").alias("n"), F.max("rank").alias("last")).collect()}
    for number, _, _, target, _ in sources:
        n, last = ranks[number]
        assert n == last + 1 >= target / 256


def test_whole_documents(odd, odd_rows):
    docs = mixed_documents(odd)
    assert docs.columns == odd.columns
    found = docs.collect()
    texts = {r[0]: r[1] for r in odd_rows}
    # The last document of a source may be cut.
    assert all(r.text is texts[r.doc_id] is None or texts[r.doc_id].startswith(r.text) for r in found)
    assert sum(r.text != texts[r.doc_id] for r in found) <= len({r[3] for r in odd_rows})
    times, counts = Counter(r.doc_id for r in found), Counter(r[0] for r in odd_rows)
    assert all(n <= 3 * counts[i] for i, n in times.items())


def test_empty(empty, docs_of):
    assert mix_counts(empty).count() == 0
    assert mixed_documents(empty).count() == 0
    assert [r.taken for r in mix_counts(docs_of([None, ""])).collect()] == [0, 0]


def words_in(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed_words(docs, **options):
    rows = mixed_documents(docs, **options).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += words_in(r.text)
    return rows, taken


def test_documents_of_the_mix_hold_each_target(spark):
    """Every source's words after the stage, with few long documents as well; a document is cut behind a word, if at all."""
    rng = random.Random(4)
    lengths = [("a", 4000), ("b", 4000), ("c", 4000), ("big", 9000), ("tiny", 1), ("none", 0)]
    rows = [(i, " \n".join(f"w{i}.{k}" for k in range(n)) + " ", s) for i, (s, n) in enumerate(lengths)]
    rows += [(100 + i, "x y\tz " * rng.randrange(80), rng.choice(["a", "d", None])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of_source = Counter()
    for _, text, source in rows:
        of_source[source] += words_in(text)
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, source_targets([of_source[s] for s in order])))
    found, taken = mixed_words(docs)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id].startswith(r.text) for r in found)
    cut = Counter(r.source for r in found if r.text != texts[r.doc_id])
    assert cut and max(cut.values()) == 1
    assert max(Counter(r.doc_id for r in found).values()) <= 3


def test_the_schedule_orders_the_documents(spark, monkeypatch):
    """The documents come as the slots do, sources near their shares in every stretch; another schedule gives another order."""
    rows = [(i, f"w{i} " * 16, "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found, _ = mixed_words(docs, block_words=16)
    of = [r.source for r in found]
    for start in range(0, 350, 50):
        assert abs(of[start : start + 50].count("a") / 50 - 5 / 7) < 0.1
    slots = {r.id: r.first_slot for r in mix_counts(docs, block_words=16).collect()}
    first = {}
    for place, r in enumerate(found):
        first.setdefault(r.doc_id, place)
    assert sorted(first, key=first.get) == sorted((i for i in slots if slots[i] is not None), key=slots.get)

    def in_turn(spark, sources, block_words):
        rows = [(number, rank) for number, _, _, target, _ in sources for rank in range(int(target // block_words) + 1)]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "slot long, number int, rank long")

    monkeypatch.setattr(mixing, "schedule", in_turn)
    assert {r.id: r.first_slot for r in mix_counts(docs, block_words=16).collect()} != slots
    assert [r.source for r in mixed_documents(docs, block_words=16).collect()] != of


def test_repeated_rows_are_mixed_each(spark):
    rows = [(1, "one two three", "a")] * 5 + [(2, "four five", "a"), (3, "six " * 20, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = source_targets([17, 20])
    _, taken = mixed_words(docs)
    assert taken["a"] == pytest.approx(targets[0], abs=1) and taken["b"] == pytest.approx(targets[1], abs=1)
