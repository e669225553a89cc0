"""The pipeline stage by stage against brute force, and every query with SQL against its SQL."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, rows_of, same_type
from labspark.llm.common import TOKENIZER, stored
from labspark.llm.mixing import mix_counts
from labspark.llm.queries import ORACLES, QUERIES
from labspark.llm.simhash import near_duplicates
from labspark.llm.tokens import Encoder


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    cursor = db.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(types) == sorted(df.columns)
    assert [(c, t, types[c]) for c, t in df.dtypes if not same_type(t, types[c])] == []
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline"}))
def test_query_covers_its_table(spark, sf, name):
    table, key = ("conversations", "conv_id") if name.startswith("op11_") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert {r[key] for r in rows} == ids


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf), f"test-{name}"))
    rows = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows[1]}
    judged = [(labels[r.doc_id], r.doc_id in kept) for r in rows[0] if r.doc_id in labels]
    assert sum(q == k for q, k in judged) / len(judged) > 0.9
    last = {}
    for r in rows[1]:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in rows[2]) == sorted(last.values())
    groups = {r.component_id for r in near_duplicates(tables[2]).collect()}
    assert sorted(r.doc_id for r in rows[3]) == sorted(groups)
    source = {r.doc_id: r.source for r in rows[3]}
    target, words = {}, dict.fromkeys(source.values(), 0)
    for r in mix_counts(tables[3]).collect():
        target[source[r.id]] = r.target
    for r in rows[4]:
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    # Each source has the words of its target; its last document is cut there.
    assert all(abs(words[s] - t) <= 1 for s, t in target.items())
    whole = {(r.doc_id, r.text) for r in rows[3]}
    assert len({r.source for r in rows[4]}) == len(target)
    assert sum((r.doc_id, r.text) not in whole for r in rows[4]) <= len(target)
    coder = Encoder(TOKENIZER)
    want = sum(len(coder.encode([r.text])[0]) + 1 for r in rows[4])
    assert sum(r.length for r in rows[5]) == want
    sequences = {r.sequence_id for r in rows[5]}
    assert len(sequences) <= -(-want // 4096) * 1.02 + 1


def test_run_gives_the_last_stage(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.count() > 0


@pytest.mark.parametrize("stage, most", [("exact_dedup", 3), ("near_dedup", 3), ("mix", 4)])
def test_last_plan_of_a_stage_is_small(spark, sf, stage, most):
    """The driver keeps plans, and what Spark says of each of their tasks: what picks rows is stored before texts are joined."""
    docs = stored(spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"]), "test-docs")
    rows = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"[-+] (?:Broadcast)?Exchange", plan)) <= most
