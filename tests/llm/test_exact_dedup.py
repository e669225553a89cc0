from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from labspark.llm.exact_dedup import drop_exact_copies, exact_classes


def brute(rows, largest):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(df):
    rows = df.select("id", "keep_id", "group_size", F.lower(F.hex("digest"))).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_odd_rows(odd, odd_rows):
    for keep in ("largest", "smallest"):
        classes = exact_classes(odd, keep=keep)
        assert found(classes) == brute(odd_rows, keep == "largest")
        kept = classes.where("kept").groupBy("digest").count().collect()
        assert {r["count"] for r in kept} == {1}
        assert len(kept) == len({r[1] or "" for r in odd_rows})


def test_many_runs_and_one_large_group(docs_of):
    texts = ["copy" if i % 3 else f"text {i % 50}" for i in range(2000)]
    for parts in (1, 7, 40):
        assert found(exact_classes(docs_of(texts).repartition(parts), keep="largest")) == brute(list(enumerate(texts)), True)


def test_rows_that_stay(odd, odd_rows):
    kept = drop_exact_copies(odd, keep="largest")
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [r.text or "" for r in rows]
    assert sorted(texts) == sorted({r[1] or "" for r in odd_rows})
    assert {r.doc_id for r in rows if r.text == odd_rows[4][1]} == {5}


def test_empty(empty):
    assert exact_classes(empty).count() == 0
    assert drop_exact_copies(empty).columns == empty.columns
