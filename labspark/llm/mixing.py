"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source form one stream: its documents in shuffled order, repeated pass after pass, cut into blocks of
equal length. A schedule names the source of each slot of the mix: golden-ratio points, mapped through the cumulative
weights, so that every stretch of the mix holds the sources close to their shares. A slot takes the next block of its
source, the one whose number is the slot's rank among the slots of that source. Blocks left over get slots at the end.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labspark.llm.common import stored, text_of, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 256
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source and cell, or slots of one stretch, that one task orders, on average.
CELL_ROWS = 2000
STRETCH_BITS = 12
LOW_BITS = 20


def source_targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> list[float]:
    """Words to take from each source, which are in order: shares of all words by weight, the weights repeating.

    A target stops at ``max_repeats`` times its source; what is over goes to the others by weight, until none is above.
    """
    targets = [0.0] * len(sizes)
    left = float(sum(sizes))
    open_ = list(range(len(sizes)))
    while open_:
        share = left / sum(weights[i % len(weights)] for i in open_)
        above = [i for i in open_ if share * weights[i % len(weights)] > max_repeats * sizes[i]]
        for i in above or open_:
            targets[i] = float(max_repeats * sizes[i]) if above else share * weights[i % len(weights)]
        if not above:
            break
        left -= sum(targets[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return targets


def sized(docs: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    """One stored row for each document: ``row``, ``id``, ``source``, ``text_hash`` and ``size``, its number of words."""
    text = text_of(text_column)
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            F.xxhash64(text).alias("text_hash"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        ),
        "sized",
    )


def source_table(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> list[tuple]:
    """``(number, source, words, target, cells)`` for each source by code point, null last.

    One row for each source reaches the driver; a source is a category, not a document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    totals.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else ""))
    targets = source_targets([r[1] for r in totals], weights, max_repeats)
    return [(i, r[0], r[1], t, -(-r[2] // CELL_ROWS)) for i, (r, t) in enumerate(zip(totals, targets))]


def schedule(spark: SparkSession, sources: list[tuple], block_words: int) -> DataFrame:
    """``slot``, ``number`` of the source and ``rank`` among the slots of that source, all from 0.

    There are a few more slots than blocks to take. What blocks a source has not got by then, as its points come late, have
    slots of their own at the end: first the next block of each such source, then the one after it.
    """
    targets = np.array([s[3] for s in sources])
    total = int(round(targets.sum()))
    slots = -(-total // block_words) + 4 * len(sources) + 64 if total else 0
    bounds = np.cumsum(targets) / max(1.0, targets.sum())
    last = int(np.flatnonzero(targets > 0)[-1]) if total else 0

    @F.pandas_udf("int")
    def source_at(points: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(bounds, points.to_numpy(), "right"), last).astype(np.int32))

    getcontext().prec = 60
    golden = (Decimal(5).sqrt() - 1) / 2
    # A slot number in two parts keeps the product's fraction exact to many digits.
    high, low = F.shiftright("slot", LOW_BITS), F.col("slot").bitwiseAND((1 << LOW_BITS) - 1)
    point = F.pmod(high * float(golden * (1 << LOW_BITS) % 1) + low * float(golden), F.lit(1.0))
    dealt = spark.range(slots).withColumnRenamed("id", "slot").withColumn("number", source_at(point))
    dealt = dealt.withColumn("stretch", F.shiftright("slot", STRETCH_BITS))
    counts = dealt.groupBy("number", "stretch").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("number", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("number", "stretch").orderBy("slot"))
    points = dealt.join(begins, ["number", "stretch"]).select(
        "slot", "number", (F.col("begin") + inside - 1).cast("bigint").alias("rank")
    )
    # One row for each source reaches the driver; points spread evenly, so a source lacks a few blocks at most.
    held = dict(dealt.groupBy("number").count().collect())
    late = [(rank - held.get(s[0], 0), s[0], rank) for s in sources for rank in range(held.get(s[0], 0), math.ceil(s[3] / block_words))]
    rows = [(slots + i, number, rank) for i, (_, number, rank) in enumerate(sorted(late))]
    return points.unionByName(spark.createDataFrame(rows, "slot long, number int, rank long")) if rows else points


def placed(sizes: DataFrame, sources: list[tuple]) -> DataFrame:
    """``sizes`` with the source's ``number``, ``words`` and ``target``, and ``begin``, the place in its shuffled stream.

    The documents of a source lie in cells, by a hash; a cell begins where the words of those before it end.
    """
    schema = "number int, _source string, words long, target double, cells long"
    table = sizes.sparkSession.createDataFrame(sources, schema)
    shuffled = F.xxhash64("id", "text_hash", F.lit("mix"))
    dealt = sizes.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("cell", F.pmod(shuffled, F.col("cells")))
    sums = dealt.groupBy("number", "cell").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("number", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cell_begin"))
    order = Window.partitionBy("number", "cell").orderBy(shuffled, "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(order), F.lit(0))
    return dealt.join(begins, ["number", "cell"]).withColumn("begin", F.col("cell_begin") + inside)


def segments(streams: DataFrame, block_words: int, max_repeats: int) -> DataFrame:
    """The part of each document in each block of each pass: ``row``, ``number``, ``rank``, ``pass``, ``place``, ``first``, ``words``.

    ``place`` is where it begins in the source's stream, over all passes; ``first`` is the document's word that the part begins with. A document without words has one part, without words.
    """
    passes = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(max_repeats)])).alias("pass")
    of = streams.select("row", "number", "size", "target", "begin", F.col("words").alias("stream"), passes)
    of = of.withColumn("at", F.col("begin") + F.col("pass") * F.col("stream"))
    end = F.least(F.col("at") + F.col("size"), F.round("target").cast("bigint"))
    of = of.withColumn("end", end).where((F.col("at") < F.col("target")) & (F.col("end") >= F.col("at")))

    def block(position: Column) -> Column:
        return F.floor(position / F.lit(block_words)).cast("bigint")

    cut = of.withColumn("rank", F.explode(F.sequence(block(F.col("at")), block(F.greatest(F.col("end") - 1, F.col("at"))))))
    low = F.greatest(F.col("at"), F.col("rank") * block_words)
    high = F.least(F.col("end"), (F.col("rank") + 1) * block_words)
    return cut.select(
        "row", "number", "rank", "pass", low.alias("place"), (low - F.col("at")).alias("first"), (high - low).alias("words")
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their places, and the mix: ``slot``, ``number``, ``row``, ``pass``, ``first``, ``words``.

    Reading the mix by slot gives the words of the mix in order. The words taken from a source are its target, rounded; none
    is taken more than ``max_repeats`` times. A null source is a source, the last; a null or empty text has no words and
    takes no room. Repeated rows are documents of their own. Empty tables and tables without words give an empty mix. The
    order is a hash, so reruns agree.
    """
    sizes = sized(docs, id_column, source_column, text_column)
    sources = source_table(sizes, weights, max_repeats)
    # Read several times: by the cutting into segments, and by callers for what else they say of a document.
    streams = stored(placed(sizes, sources), "streams")
    parts = segments(streams, block_words, max_repeats)
    return streams, schedule(docs.sparkSession, sources, block_words).join(parts, ["number", "rank"])


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """For each document: ``id``, ``size``, ``source_size``, ``target`` of its source, ``taken``, its words in the mix, and
    ``first_slot``, the slot that has its first part, null if the mix has none."""
    streams, mixed = mix(docs, **options)
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return streams.join(taken, "row", "left").select(
        "id",
        "size",
        F.col("words").alias("source_size"),
        "target",
        F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"),
        "first_slot",
    )


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options
) -> DataFrame:
    """The mix as documents, with the columns of ``docs``, in the order of their first slots.

    A document stands there once for each pass that takes of it. The last one of a source is cut where the source's target
    ends, behind a word, and has its text up to there; so each source has the words of its target, and none vanishes. A
    document without words stands there if its place is before the target.
    """
    streams, mixed = mix(docs, id_column, source_column, text_column, **options)
    key = F.struct("id", "source", "text_hash").alias("key")
    known = streams.select("row", "size", key)
    taken = mixed.groupBy("row", "pass").agg(F.min(F.struct("slot", "place")).alias("at"), F.sum("words").alias("words"))
    parts = taken.join(known, "row").where((F.col("words") > 0) | (F.col("size") == 0))
    parts = parts.select("row", "key", F.struct("at", F.when(F.col("words") < F.col("size"), F.col("words")).alias("cut")).alias("part"))
    # One row for each document with its parts, one for each pass at most. The schedule is planned and run once, for this table.
    once = stored(parts.groupBy("row", "key").agg(F.collect_list("part").alias("parts")), "parts")
    copies = stored(known.groupBy("key").count().where("count > 1").select("key"), "copies")
    again = None
    if not copies.isEmpty():
        # Documents that are there several times; for them one row for each part.
        again = once.join(copies, "key", "left_semi").select("key", F.explode("parts").alias("part"))
        once = once.join(copies, "key", "left_anti")
    own, of, part = (unused(name, docs) for name in ("_own", "_of", "_part"))
    marked = docs.withColumn(
        own,
        F.struct(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.xxhash64(text_of(text_column)).alias("text_hash")),
    )
    same = F.col(own).eqNullSafe(F.col(of))
    single = marked.join(once.select(F.col("key").alias(of), F.col("parts").alias(part)), same).withColumn(part, F.explode(part))
    rows = single if again is None else single.unionByName(repeated(marked, again, own, of, part))
    cut = F.col(part)["cut"]
    pieces = F.regexp_extract_all(F.col(text_column), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(cut.isNull(), F.col(text_column)).otherwise(F.array_join(F.slice(pieces, F.lit(1), cut.cast("int")), ""))
    rows = rows.withColumn(text_column, text.cast(docs.schema[text_column].dataType))
    return rows.orderBy(F.col(part)["at"]).select(*docs.columns)


def repeated(marked: DataFrame, parts: DataFrame, own: str, of: str, part: str) -> DataFrame:
    """One row of each ``key`` of ``parts`` for each of its parts; the rows of a key are alike."""
    named = parts.select(F.col("key").alias(of), F.col("part").alias(part))
    same = F.col(own).eqNullSafe(F.col(of))
    one = marked.join(named.select(of).distinct(), same, "left_semi").dropDuplicates([own])
    return one.join(named, same)
