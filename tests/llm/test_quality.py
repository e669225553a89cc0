from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from labspark.llm.quality import ALWAYS, TIMES, bags, drop_low_quality, features, fit, held_out, score


def corpus(n, seed=0):
    rng = random.Random(seed)
    syllables = "the an er ing tion ha re on st ou".split()
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3]))) for _ in range(rng.choice([8, 60, 300]))]
        good = i % 3 > 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words[:20] for _ in range(6)]
        out.append((i, " ".join(words), int(good)))
    return out


def test_features_do_not_depend_on_the_batch(odd_rows):
    texts = [r[1] or "" for r in odd_rows] + [t for _, t, _ in corpus(20)]
    alone = [bags([t])[0] for t in texts]
    for (b, s), (c, u) in zip(bags(texts), alone):
        assert (b == c).all() and np.allclose(s, u)
    assert alone[1][0].tolist() == [ALWAYS]
    for buckets, of in features(texts):
        assert (np.diff(of) >= 0).all() and len(buckets) == len(of)


def test_repeated_words_share_a_feature():
    once, other = bags(["aa aa"])[0][0], bags(["zz zz"])[0][0]
    assert len(set(once) & set(other) - {ALWAYS}) == 1
    assert TIMES > 0


def test_learns_and_keeps_clean_documents(spark):
    rows = corpus(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality")
    model = fit(docs, labels.where(~held_out("doc_id")))
    found = docs.select("quality", held_out("doc_id").alias("held"), score(model).alias("s")).where("held").collect()
    assert len(found) > 100
    assert np.mean([(r.s >= 0.7) == r.quality for r in found]) > 0.97
    again = fit(docs.repartition(5), labels.where(~held_out("doc_id")))
    assert np.array_equal(model.table, again.table)


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality")
    flipped = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (fit(docs, x.where(~held_out("doc_id"))) for x in (labels, flipped))
    assert np.array_equal(one.table, two.table)


def test_odd_rows_and_labels(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (4, None), (None, 1), (5, 7), (99, 1)], "doc_id long, quality int")
    model = fit(odd, labels)
    kept = drop_low_quality(odd, model)
    assert kept.columns == odd.columns
    scores = odd.select(score(model).alias("s")).collect()
    assert len(scores) == len(odd_rows) and all(0 <= r.s <= 1 for r in scores)
    blank = fit(odd, labels.limit(0))
    assert {r.s for r in odd.select(score(blank).alias("s")).collect()} == {0.5}
    assert drop_low_quality(empty, model).count() == 0
