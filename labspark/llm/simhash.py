"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import keep_rows, stored, text_of, unused
from labspark.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a tile, on average at most.
TILE_ROWS = 4096
HALF = (1 << 32) - 1


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text.

    A-Z are lower-cased, words are what stands between ASCII white space, and every shingle of ``words`` words counts as
    often as it occurs; a text with fewer words is one shingle. A bit is 1 if it is set in over half of the hashes. A text
    without words has 0.
    """
    data = text.encode("utf-8", "surrogatepass").lower()
    parts = data.split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    of = xxhash.xxh64_intdigest
    stops = ends[words - 1 :].tolist() or [len(line)]
    hashes = np.array([of(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        some = hashes[first : first + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id``, ``text_hash`` and ``fingerprint``, as a signed number of the same bits, for each row; stored."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = []
            for first in range(0, len(texts), 256):
                found += [fingerprint(t, words) for t in texts.slice(first, 256).to_pylist()]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "text_hash")), prints], names)

    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    names = ["id", "text_hash", "fingerprint"]
    return stored(rows.mapInArrow(of, "id long, text_hash long, fingerprint long"), "fingerprints")


def tile_links(mine: np.ndarray, theirs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two tiles of fingerprints within ``radius`` bits that span every group they form.

    All pairs are compared, a few rows at a time. What links values of one group already is not given again, so a group
    of any size gives fewer pairs than it has values.
    """
    n = len(mine)
    group = np.arange(n + len(theirs))
    a_out: list[np.ndarray] = []
    b_out: list[np.ndarray] = []
    step = max(1, (1 << 17) // max(1, len(theirs)))
    for first in range(0, n, step):
        apart = np.bitwise_count(mine[first : first + step, None] ^ theirs[None, :])
        rows, columns = np.nonzero(apart <= radius)
        if not len(rows):
            continue
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for a, near in zip(rows[np.concatenate([[0], cuts])] + first, np.split(columns, cuts)):
            groups, which = np.unique(group[n + near], return_index=True)
            new = groups != group[a]
            if new.any():
                a_out.append(np.full(new.sum(), mine[a]))
                b_out.append(theirs[near[which[new]]])
                group[np.isin(group, groups[new])] = group[a]
    if not a_out:
        return mine[:0], theirs[:0]
    return np.concatenate(a_out), np.concatenate(b_out)


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges ``a``, ``b`` between the distinct values of ``prints`` (column ``fingerprint``) that join every two values
    within ``radius`` bits, directly or over others within it.

    Values are dealt to tiles by the population counts of their two halves, and large classes of counts to several tiles
    by a hash. Values within the radius differ in these counts by no more than it in sum, so other pairs of tiles are
    never formed. Each pair is compared whole. The table of classes has at most 33 * 33 rows.
    """
    spark = prints.sparkSession
    half = F.lit(HALF).cast("bigint")
    counted = prints.select("fingerprint").distinct().select(
        F.col("fingerprint").alias("value"),
        F.bit_count(F.shiftrightunsigned("fingerprint", 32)).alias("high"),
        F.bit_count(F.col("fingerprint").bitwiseAND(half)).alias("low"),
    )
    values = stored(counted, "values")
    pairs = class_pairs({(r[0], r[1]): r[2] for r in values.groupBy("high", "low").count().collect()}, radius, tile_rows)
    table = spark.createDataFrame(
        pairs, "batch int, pair int, high int, low int, high2 int, low2 int, tiles long, tiles2 long"
    )

    key = ["batch", "tile", "tile2"]

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    def dealt(high: str, low: str, own: str, count: str, other: str, other_count: str) -> DataFrame:
        """Each value with its tile, once for each tile of each class that its own class meets."""
        renamed = values.select("value", F.col("high").alias(high), F.col("low").alias(low))
        met = renamed.join(F.broadcast(table), [high, low]).withColumn(own, F.pmod(F.xxhash64("value"), F.col(count)))
        one_class = (F.col("high") == F.col("high2")) & (F.col("low") == F.col("low2"))
        # Of two tiles of one class only one order is needed.
        once = met.withColumn(other, numbers(other_count)).where(~one_class | (F.col("tile") <= F.col("tile2")))
        return once.select(*[F.col(c).alias(c) for c in [*key, "pair", "value"]])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [tile_links(x, y, radius) for x, y in meeting(a, b)]
        ends = (np.concatenate([np.empty(0, np.uint64), *(f[i] for f in found)]).view(np.int64) for i in (0, 1))
        return pd.DataFrame(dict(zip("ab", ends)))

    left = dealt("high", "low", "tile", "tiles", "tile2", "tiles2")
    right = dealt("high2", "low2", "tile2", "tiles2", "tile", "tiles")
    grouped = left.groupBy(*key).cogroup(right.groupBy(*key))
    return grouped.applyInPandas(compare, "a long, b long").where("a <> b")


def class_pairs(sizes: dict[tuple[int, int], int], radius: int, tile_rows: int) -> list[tuple]:
    """Pairs of classes that may hold values within ``radius``: at most 41 for each of the 33 * 33, half of them.

    Pairs of small classes share a batch, of about four tiles' rows; a pair with a class of several tiles has its own.
    """
    out, batch, rows = [], 0, 0
    for (high, low), n in sorted(sizes.items()):
        for (high2, low2), m in sorted(sizes.items()):
            if abs(high - high2) + abs(low - low2) > radius or (high, low) > (high2, low2):
                continue
            tiles, tiles2 = -(-n // tile_rows), -(-m // tile_rows)
            alone = tiles > 1 or tiles2 > 1
            if alone or rows + n + m > 4 * tile_rows:
                batch, rows = batch + 1, 0
            out.append((batch, len(out), high, low, high2, low2, tiles, tiles2))
            batch, rows = (batch + 1, 0) if alone else (batch, rows + n + m)
    return out


def meeting(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The values of the two sides, pair by pair."""

    def split(side: pd.DataFrame) -> dict[int, np.ndarray]:
        pair, value = side["pair"].to_numpy(), side["value"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(pair, kind="stable")
        names, first = np.unique(pair[order], return_index=True)
        return dict(zip(names.tolist(), np.split(value[order], first[1:])))

    mine, theirs = split(a), split(b)
    for pair in sorted(mine.keys() & theirs.keys()):
        yield mine[pair], theirs[pair]


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``id``, ``text_hash``, ``fingerprint``, ``root`` and ``component_id`` for each row of ``docs``.

    ``root`` is the smallest fingerprint of the component, as a signed number. Rows whose fingerprints are linked, over any number of steps, share a component; its id is the smallest identifier in
    it, null identifiers aside. Empty and null texts have fingerprint 0 and are linked like others. Repeated rows share a
    component. An empty table gives no rows. Texts are compared by their fingerprints alone, each distinct value once, so
    copies cost nothing here, and a group of near copies sends one spanning tree from each pair of tiles.
    """
    rows = fingerprints(docs, id_column, text_column, words)
    joined = components(links(rows, radius, tile_rows))
    # Roots for all values; those without a link are their own.
    least = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    grouped = least.join(joined, F.col("fingerprint") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    of_root = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_value = grouped.select("fingerprint", "root").join(of_root, "root")
    return rows.join(of_value, "fingerprint").select("id", "text_hash", "fingerprint", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row of each component, the one with the smallest identifier, with the columns of ``docs``.

    Of rows that share that identifier, the one with the smallest hash of its text stays.
    """
    found = near_duplicates(docs, id_column, text_column, **options)
    chosen = F.struct("id", "text_hash")
    first = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id", "text_hash")
    one = first.agg(F.count(F.lit(1)).alias("copies")).groupBy("root").agg(
        F.min_by(F.struct(chosen.alias("key"), "copies"), "text_hash").alias("best")
    )
    own = F.struct(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text_of(text_column)).alias("text_hash"))
    name = unused("_near", docs)
    return keep_rows(docs.withColumn(name, own), one.select("best.key", "best.copies"), name).drop(name)
