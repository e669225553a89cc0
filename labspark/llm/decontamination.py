"""Benchmark passages in documents: winnowed fingerprints of both sides are joined, and hits extended word by word.

Everything is DataFrame functions. A fingerprint is the hash of ``GRAM`` words. Of each ``SPAN - GRAM + 1`` fingerprints in a
row the smallest is kept, so a run of ``SPAN`` words keeps the same fingerprints wherever it stands, and a document and an
item that share such a run share one of them. A kept fingerprint carries the words around it, as far as a run that holds it
can reach; where a fingerprint of a document meets one of an item, those words are compared, so no result rests on a hash.

Before the join, fingerprints of documents are sieved by a bit map of the items' fingerprints. Its size is bounded, it drops
only what can't meet anything, and it leaves so few rows that the join costs little however Spark carries it out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.llm.common import stored, text_of

#: Words of a run that counts, and of a fingerprint.
SPAN = 10
GRAM = 5
#: Bits of the sieve for each fingerprint of the items, and its size in bits at most.
SIEVE_BITS = 64
SIEVE_LARGEST = 1 << 22
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FOUND = "array<struct<pos: int, hash: bigint, left: array<string>, right: array<string>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def places(count: Column) -> Column:
    """0 to ``count`` - 1; none if it is below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def grams(hashes: Column, length: int) -> Column:
    """The hash of each ``length`` words in a row, from the hashes of the words."""
    return F.transform(
        places(F.size(hashes) - (length - 1)),
        lambda i: F.xxhash64(F.lit(length), *[F.get(hashes, i + j) for j in range(length)]),
    )


def winnowed(found: Column, window: int) -> Column:
    """The places of the fingerprints that are the smallest of some ``window`` of them in a row."""
    around = range(window)

    def kept(least: Column) -> Column:
        # A window's minimum is never above a member of it, so a member is some window's minimum if the largest of them is it.
        def smallest(i: Column) -> Column:
            return F.get(found, i) == F.greatest(*[F.get(least, i - j) for j in around])

        return F.filter(places(F.size(found)), smallest)

    least = F.transform(places(F.size(found) - (window - 1)), lambda i: F.least(*[F.get(found, i + j) for j in around]))
    return let(least, lambda m: F.when(F.size(m) > 0, kept(m)).otherwise(F.array().cast("array<int>")))


def fingerprints(
    tokens: Column, short: list[int], span: int, gram: int, passes: Callable[[Column], Column] | None = None
) -> Column:
    """``pos``, ``hash`` and the words ``left`` (from the nearest) and ``right`` of the place, for the fingerprints of a text.

    The winnowed ones of ``gram`` words come with up to ``span`` - ``gram`` words on the left; for each length in ``short``
    follow all runs of that length, without others. ``passes`` leaves out what it is false for.
    """

    def entry(found: Column, i: Column, ahead: int, length: int) -> Column:
        before = F.least(i, F.lit(ahead))
        left = F.reverse(F.slice(tokens, i - before + 1, before)) if ahead else F.array().cast("array<string>")
        return F.struct(i.alias("pos"), F.get(found, i).alias("hash"), left.alias("left"), F.slice(tokens, i + 1, length).alias("right"))

    def sieved(found: Column, at: Column) -> Column:
        return at if passes is None else F.filter(at, lambda i: passes(F.get(found, i)))

    def long_runs(found: Column) -> Column:
        at = sieved(found, winnowed(found, span - gram + 1))
        return F.transform(at, lambda i: entry(found, i, span - gram, span))

    def runs(length: int) -> Callable[[Column], Column]:
        return lambda found: F.transform(sieved(found, places(F.size(found))), lambda i: entry(found, i, 0, length))

    def both(hashes: Column) -> Column:
        parts = [let(grams(hashes, gram), long_runs), *[let(grams(hashes, n), runs(n)) for n in short]]
        return F.concat(*parts).cast(FOUND)

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), both)


def item_fingerprints(items: DataFrame, item_column: str, text_column: str, span: int, gram: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """The items' different fingerprints with their words (``place`` names them), the items of each place, and the lengths
    of the items shorter than ``span``, which count as a whole."""
    rows = stored(
        items.select(F.col(item_column).cast("string").alias("item"), words(text_of(text_column)).alias("w")).where(F.size("w") > 0).distinct(),
        "benchmark-words",
    )
    size = F.size("w")
    short = sorted(r[0] for r in rows.where(size < span).select(size.alias("n")).distinct().collect())
    long_ones = rows.where(size >= span).select("item", let(F.col("w"), lambda w: fingerprints(w, [], span, gram)).alias("f"))
    parts = [long_ones.select("item", F.inline("f"), F.lit(span).alias("need"))]
    for n in short:
        whole = F.xxhash64(F.lit(n), *[F.xxhash64(F.get("w", F.lit(j))) for j in range(n)])
        none = F.array().cast("array<string>")
        parts.append(rows.where(size == n).select("item", F.lit(0).alias("pos"), whole.alias("hash"), none.alias("left"), F.col("w").alias("right"), F.lit(n).alias("need")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    key = ["hash", "left", "right", "need"]
    named = found.select("item", *key, F.sha2(F.to_json(F.struct(*key)), 256).alias("place"))
    known = stored(named.distinct(), "benchmark-fingerprints")
    return known.select("place", *key).distinct(), known.select("place", "item").distinct(), short


def sieve(known: DataFrame, count: int) -> Callable[[Column], Column]:
    """Whether a hash may be among those of ``known``: a bit map of 64 bits a fingerprint, ``SIEVE_LARGEST`` at most.

    The driver gets one number for every 64 bits that has any, at most ``SIEVE_LARGEST`` / 64 of them.
    """
    slots = 1
    while slots * 64 < min(max(1, count) * SIEVE_BITS, SIEVE_LARGEST):
        slots *= 2

    def slot(h: Column) -> Column:
        return F.shiftright(h, 6).bitwiseAND(F.lit(slots - 1))

    def bit(h: Column) -> Column:
        return h.bitwiseAND(F.lit(63)).cast("int")

    # A word's 64 bits as an exact sum of its different bits; the highest is the sign.
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("hash")))
    masks = dict(known.groupBy(slot(F.col("hash")).alias("slot")).agg(F.bit_or(one)).collect())
    # As one text, which Spark turns into an array once, when it plans.
    table = F.split(F.lit(",".join(str(masks.get(i, 0)) for i in range(slots))), ",").cast("array<bigint>")
    return lambda h: F.getbit(F.get(table, slot(h).cast("int")), bit(h)) == 1


def agreeing(a: Column, b: Column) -> Column:
    """How many words two lists have in common from their start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first_other = F.array_position(same, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """For each row of ``docs``: ``id``, ``n_words``, ``spans`` and ``items``.

    A run of ``span`` words in a row of an item is looked for, or the whole item if it has fewer. ``spans`` are the ranges of
    words (``start`` from 0, ``end`` exclusive) that such runs cover, apart and in order; ``items`` the identifiers, as
    strings in order, of the items that have one of the runs. Words: A-Z count as a-z, and all but ASCII letters, digits and
    what lies beyond ASCII stands between them. A null or empty text, or one without words, has none, and neither has a row
    when ``items`` is empty. An item without words is nowhere; items that share an identifier count once. Repeated rows of
    ``docs``, and rows without an identifier, each get their own row. An empty table gives no rows.

    The texts are read once. What is kept of them in the shared folder are their numbers of words and the fingerprints that
    pass the sieve; a document's hits are gathered in one row, as its text is.
    """
    known, places_of, short = item_fingerprints(items, item_column, item_text_column, span, gram)
    known = stored(known, "benchmark-places")
    passes = sieve(known, known.count())

    def scanned(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), fingerprints(w, short, span, gram, passes).alias("found"))

    read = docs.select(
        F.col(id_column).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        let(words(text_of(text_column)), scanned).alias("s"),
    )
    rows = stored(read.select("id", "row", "s.n_words", "s.found"), "document-fingerprints")
    candidates = rows.where(F.size("found") > 0).select("row", F.inline("found"))
    theirs = known.select("place", "hash", F.col("left").alias("l"), F.col("right").alias("r"), "need")
    met = candidates.join(theirs, "hash").select(
        "row", "pos", "place", "need", agreeing(F.col("left"), F.col("l")).alias("before"), agreeing(F.col("right"), F.col("r")).alias("after")
    )
    hits = met.where(F.col("before") + F.col("after") >= F.col("need"))
    hits = stored(hits.select("row", "place", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end")), "benchmark-hits")
    named = hits.select("row", "place").distinct().join(places_of, "place").select("row", "item").distinct()
    names = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    joined = rows.select("id", "row", "n_words").join(united(hits), "row", "left").join(names, "row", "left")
    none, nothing = F.array().cast("array<struct<start: int, end: int>>"), F.array().cast("array<string>")
    return joined.select("id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", nothing).alias("items"))


def united(ranges: DataFrame) -> DataFrame:
    """``row`` and ``spans``: the ranges of each row with those that touch or overlap made one, in order."""
    along = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("start") <= reach, 0).otherwise(1)
    numbered = ranges.select("row", "start", "end").distinct().withColumn("apart", apart)
    numbered = numbered.withColumn("n", F.sum("apart").over(along))
    spans = numbered.groupBy("row", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
