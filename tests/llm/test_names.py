"""Columns of other names go through every operator and stage that returns the columns of its documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labspark.llm.exact_dedup import drop_exact_copies
from labspark.llm.mixing import mixed_documents
from labspark.llm.pii import personal_data, redacted
from labspark.llm.quality import drop_low_quality, fit
from labspark.llm.simhash import drop_near_duplicates

NAMES = "_key _copies _times _class _near _mix _id _label _score _spans _own _of _part key copies id digest row slot part".split()


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(i, f"some words of text number {i // 2} that a@b.co wrote, and more of them " * 3, "en", f"src{i % 2}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in NAMES:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    return docs


def model(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("id"), F.lit(2).alias("label"))
    return fit(docs, labels)


OPERATORS = {
    "drop_exact_copies": drop_exact_copies,
    "mixed_documents": mixed_documents,
    "drop_near_duplicates": drop_near_duplicates,
    "drop_low_quality": lambda docs: drop_low_quality(docs, model(docs), threshold=0.0),
    "redacted": lambda docs: redacted(docs, personal_data(docs)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_and_values_stay(clash, name):
    found = OPERATORS[name](clash)
    assert found.columns == clash.columns
    rows = found.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"{c}{r.doc_id}" for c in NAMES)


def test_stages(spark, sf, clash):
    labelled = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id").limit(40).collect()
    docs = clash.where(F.col("doc_id") < len(labelled))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns and found.count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
