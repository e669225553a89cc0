"""From raw documents to packed training sequences: the stages and a run over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labspark.llm.common import TOKENIZER, documents, importable, labels, stored
from labspark.llm.exact_dedup import drop_exact_copies
from labspark.llm.mixing import mixed_documents
from labspark.llm.packing import pack_documents
from labspark.llm.quality import drop_low_quality, fit, held_out
from labspark.llm.simhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@importable
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out."""
    known = labels(spark, sf_dir)
    return drop_low_quality(docs, fit(docs, known.where(~held_out("doc_id"))))


@importable
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest identifier."""
    return drop_exact_copies(docs, keep="largest")


@importable
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest identifier."""
    return drop_near_duplicates(docs)


@importable
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    return mixed_documents(docs)


@importable
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in training sequences."""
    return pack_documents(docs, TOKENIZER).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: A classifier, fingerprints and token ids are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one returns is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
