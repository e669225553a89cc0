"""Secrets in texts: strict patterns, and a battery of randomness tests for what they don't know.

Everything is DataFrame functions. Strict patterns give the base spans. All other runs of at least ``MIN_TOKEN`` characters
of a key's alphabet are tested: their encoding is inferred, and of its symbols the uniformity (chi-squared), the runs above
and below the middle and the serial correlation are tested. A token that no test finds unlike random symbols gets a p-value
under the opposite hypothesis, that text of its length and encoding would look so uniform by chance. A short token can't
get a small one. The tokens to report are then chosen over the whole corpus by the false-discovery rate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.llm.common import stored, text_of

KINDS = ("assign", "access", "hex", "random")
NAMED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
MIN_TOKEN = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: A test rejects randomness below this p-value.
REJECT = 0.001
#: The share of text among the tokens reported, at most, as expected.
FALSE_DISCOVERIES = 0.05
BINS = 20  # for each power of ten

#: Encodings in the order they are tried: pattern, symbols in order, and the chance that two symbols of a text written in
#: it are the same: 0.0667 for English letters (a fixed value), less where cases and digits mix, 0.1 for digits alone.
ENCODINGS = (
    ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.1),
    ("^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.0667),
    ("^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 0.06),
    ("^([a-z0-9]+|[A-Z0-9]+)$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.06),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055),
)

MARK, STAND_IN = "\x01", "\x02"


def matches(text: Column, pattern: str) -> Column:
    """The leftmost, not overlapping matches of a pattern: ``start``, ``end`` in code points, and ``match``.

    Matches are put between marks and the text is split there; a mark in the text itself is first exchanged for another
    character that no pattern knows.
    """
    marked = F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, f"{MARK}$0{MARK}")
    parts = F.split(marked, MARK)
    empty = F.array().cast("array<struct<start: bigint, end: bigint, match: string>>")

    def placed(parts: Column) -> Column:
        # Adding to an array copies it, so the parts are placed in runs of about as many as there are runs.
        length = F.ceil(F.sqrt(F.size(parts))).cast("int")
        length = length + length % 2
        begins = F.sequence(F.lit(1), F.size(parts), length)
        runs = F.transform(begins, lambda i: F.slice(parts, i, length))
        sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda n, part: n + F.length(part)))
        none = F.array().cast("array<bigint>")
        start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("starts"))
        starts = F.aggregate(
            sizes,
            start,
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
            lambda s: s["starts"],
        )
        return F.flatten(F.zip_with(runs, starts, found_in))

    def found_in(run: Column, start: Column) -> Column:
        # Every second part is a match; runs begin with a part between matches.
        begin = F.struct(start.alias("at"), F.lit(False).alias("inside"), empty.alias("found"))

        def step(state: Column, part: Column) -> Column:
            end = state["at"] + F.length(part)
            entry = F.struct(state["at"].alias("start"), end.alias("end"), part.alias("match"))
            found = F.when(state["inside"], F.concat(state["found"], F.array(entry))).otherwise(state["found"])
            return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), found.alias("found"))

        return F.aggregate(run, begin, step, lambda s: s["found"])

    return F.when(F.size(parts) > 1, F.get(F.transform(F.array(parts), placed), F.lit(0))).otherwise(empty)


def upper_tail(z: Column) -> Column:
    """The chance that a standard normal value is above ``z``, by the rational approximation of Zelen and Severo."""
    t = 1 / (1 + F.abs(z) * 0.2316419)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(tokens: Column) -> Column:
    """``start``, ``end`` and ``p`` of each token: 1 if a test rejects randomness, else its chance among texts.

    Encodings: see ``ENCODINGS``. Each line below adds to the structs what the next ones need.
    """

    def encoding(token: Column) -> Column:
        chosen = None
        for i in reversed(range(len(ENCODINGS))):
            one = F.lit(i)
            chosen = one if chosen is None else F.when(token.rlike(ENCODINGS[i][0]), one).otherwise(chosen)
        return chosen

    def of(encoding: Column, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), encoding + 1)

    last = len(ENCODINGS) - 1

    def parsed(token: Column) -> Column:
        kind = encoding(token["match"])
        plain = F.translate(F.rtrim(token["match"], F.lit("=")), "-_", "+/")
        folded = F.when(kind == last, plain).otherwise(F.lower(plain))
        letters = F.regexp_extract_all(folded, F.lit("(.)"), F.lit(1))
        symbols = of(kind, [e[1] for e in ENCODINGS])
        values = F.transform(letters, lambda c: (F.instr(symbols, c) - 1).cast("double"))
        return F.struct(
            token["start"].alias("start"),
            token["end"].alias("end"),
            values.alias("v"),
            of(kind, [float(len(e[1])) for e in ENCODINGS]).alias("k"),
            of(kind, [e[2] for e in ENCODINGS]).alias("same"),
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def counted(t: Column) -> Column:
        n = F.size(t["v"]).cast("double")
        squares = F.transform(F.array_distinct(t["v"]), lambda c: F.pow(F.size(F.filter(t["v"], lambda x: x == c)).cast("double"), F.lit(2.0)))
        high = F.size(F.filter(t["v"], lambda x: x >= t["k"] / 2)).cast("double")
        pairs = F.arrays_zip(F.slice(t["v"], F.lit(1), F.greatest(F.size(t["v"]) - 1, F.lit(0))).alias("a"), F.slice(t["v"], 2, F.size(t["v"])).alias("b"))
        turns = F.filter(pairs, lambda p: (p["a"] >= t["k"] / 2) != (p["b"] >= t["k"] / 2))
        mean = total(t["v"]) / n
        return F.struct(
            *[t[c].alias(c) for c in ("start", "end", "v", "k", "same")],
            pairs.alias("pairs"),
            n.alias("n"),
            mean.alias("mean"),
            high.alias("high"),
            (F.size(turns) + 1).cast("double").alias("runs"),
            (total(squares) * t["k"] / n - n).alias("chi"),
        )

    def statistics(t: Column) -> Column:
        degrees = t["k"] - 1
        # Chi-squared as a normal value by Wilson and Hilferty's cube root.
        cube = (F.pow(t["chi"] / degrees, F.lit(1 / 3)) - (1 - 2 / (9 * degrees))) / F.sqrt(2 / (9 * degrees))
        expected = 2 * t["high"] * (t["n"] - t["high"]) / t["n"] + 1
        spread = F.sqrt((expected - 1) * (expected - 2) / (t["n"] - 1))
        runs = F.when(expected > 2, (t["runs"] - expected) / F.nullif(spread, F.lit(0.0)))
        around = total(F.transform(t["v"], lambda x: F.pow(x - t["mean"], F.lit(2.0))))
        along = total(F.transform(t["pairs"], lambda p: (p["a"] - t["mean"]) * (p["b"] - t["mean"])))
        serial = (along / F.nullif(around, F.lit(0.0)) + 1 / (t["n"] - 1)) * F.sqrt(t["n"] - 1)
        # Of text: chi-squared with a noncentrality that grows with the length.
        shift = t["n"] * (t["k"] * t["same"] - 1)
        text = (t["chi"] - degrees - shift) / F.sqrt(2 * degrees + 4 * shift)
        return F.struct(
            t["start"].alias("start"), t["end"].alias("end"), cube.alias("cube"), runs.alias("z1"), serial.alias("z2"), text.alias("text")
        )

    def judged(t: Column) -> Column:
        random = (upper_tail(t["cube"]) >= REJECT) & (2 * upper_tail(F.abs(t["z1"])) >= REJECT)
        random = F.coalesce(random & (2 * upper_tail(F.abs(t["z2"])) >= REJECT), F.lit(False))
        p = F.when(random, F.greatest(upper_tail(-t["text"]), F.lit(1e-300))).otherwise(1.0)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), p.alias("p"))

    for step in (parsed, counted, statistics, judged):
        tokens = F.transform(tokens, step)
    return tokens


def cut_off(tests: DataFrame, rate: float) -> float:
    """The largest p-value to report, by Benjamini and Hochberg's rule over all tests of the corpus (column ``p``).

    P-values are counted in bins of a twentieth of a power of ten, some thousand at most; all of a bin counts as its upper
    end. 0 if nothing is to be reported.
    """
    order = F.floor(-F.log10("p") * BINS).cast("int")
    counts = sorted(tests.groupBy(order.alias("bin")).count().collect(), reverse=True)
    total, seen, best = sum(c for _, c in counts), 0, 0.0
    for number, count in counts:
        seen += count
        if 10 ** (-number / BINS) <= rate * seen / total:
            best = 10 ** (-number / BINS)
    return best if best < 1 else 0.0


def secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rate: float = FALSE_DISCOVERIES
) -> DataFrame:
    """``id``, ``base`` and ``added`` for each row: arrays of ``start``, ``kind`` (its place in ``KINDS``) and ``end``.

    Both are ordered by start, then kind; places count code points, and ends are exclusive. Added spans overlap no base
    span. A null or empty text has none. Repeated rows get the same. An empty table gives no rows. The texts are read once;
    what is kept of them in the shared folder are spans and p-values.
    """
    text = text_of(text_column)
    named = F.filter(matches(text, NAMED), lambda m: F.length(F.regexp_extract(m["match"], NAMED, 1)) >= MIN_VALUE)
    found = docs.select(
        F.col(id_column).alias("id"),
        named.alias("assign"),
        matches(text, ACCESS).alias("access"),
        matches(text, HEX).alias("hex"),
        tested(matches(text, TOKEN)).alias("tokens"),
    )

    def spans(column: str) -> Column:
        kind = F.lit(KINDS.index(column) if column in KINDS else len(KINDS) - 1)
        return F.transform(column, lambda m: F.struct(m["start"].alias("start"), kind.alias("kind"), m["end"].alias("end")))

    base = F.array_sort(F.concat(spans("assign"), spans("access"), spans("hex")))
    found = found.select("id", F.monotonically_increasing_id().alias("row"), base.alias("base"), "tokens")
    rows = stored(found, "secrets")
    limit = cut_off(rows.select(F.explode("tokens.p").alias("p")), rate)
    rows = rows.withColumn("tokens", F.filter("tokens", lambda t: t["p"] <= limit))
    both = (F.size("tokens") > 0) & (F.size("base") > 0)
    alone = rows.where(~both).select("id", "base", F.array_sort(spans("tokens")).alias("added"))
    mixed = rows.where(both)
    free = apart(mixed).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("tokens"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    kept = mixed.select("id", "row", "base").join(free, "row", "left").withColumn("tokens", F.coalesce("tokens", none))
    return alone.unionByName(kept.select("id", "base", F.array_sort(spans("tokens")).alias("added")))


def apart(rows: DataFrame) -> DataFrame:
    """``row``, ``start`` and ``end`` of the tokens that overlap no base span of their row.

    In order of their starts, a base span that overlaps a token either reaches past its start from before, or is the next one
    and starts before its end: tokens don't overlap each other, so behind another token no base span can.
    """

    def marked(column: str, is_base: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(is_base).alias("is_base")))

    spans = rows.select("row", F.inline(F.concat(marked("base", 1), marked("tokens", 0))))
    along = Window.partitionBy("row").orderBy("start", F.desc("is_base"), "end")
    reach = F.max(F.when(F.col("is_base") == 1, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    follows = F.when(F.lead("is_base").over(along) == 1, F.lead("start").over(along))
    looked = spans.select("row", "start", "end", "is_base", reach.alias("reach"), follows.alias("follows"))
    clear = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("follows") >= F.col("end"), F.lit(True))
    return looked.where((F.col("is_base") == 0) & clear).select("row", "start", "end")
