"""Log lines: parsing, enrichment, search, tails, progress and call edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.plans.numbering import numbered
from labspark.plans.topn import first_n

COMMENT_LINE = "^\\s*#[^:]*$"
# Frames between two progress messages, and the message.
FRAMES_PER_MESSAGE = 100
PROGRESS_TEXT = "Docker container activity: %d frames processed"


def parse_json(df: DataFrame, schema: T.StructType, body: str = "body", parsed: str = "parsed") -> DataFrame:
    """Add the parsed body; a broken one is kept, its fields null and ``malformed`` true."""
    bad = "_corrupt_record"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    found = F.from_json(F.col(body), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    names = [F.col("_parsed")[field.name].alias(field.name) for field in schema.fields]
    return (
        df.withColumn("_parsed", found)
        .withColumn("malformed", F.col(f"_parsed.{bad}").isNotNull())
        .withColumn(parsed, F.struct(*names))
        .drop("_parsed")
    )


def enrich(df: DataFrame, attributes: Mapping[str, Column | str], host: Column | None = None) -> DataFrame:
    """Attach fixed attributes and, when given, the host as ``host_name``."""
    added = [
        (value if isinstance(value, Column) else F.lit(value)).alias(name) for name, value in attributes.items()
    ]
    if host is not None:
        added.append(host.alias("host_name"))
    return df.select("*", *added)


def search(df: DataFrame, wanted: Mapping[str, object], ts: str | None = None, tie: str | None = None) -> DataFrame:
    """Lines whose columns equal all wanted values, newest first when ``ts`` is given.

    ``tie`` orders lines of one time, and lets Spark spread them when very many share it.
    """
    keep = reduce(lambda a, b: a & b, [F.col(name) == F.lit(value) for name, value in wanted.items()], F.lit(True))
    found = df.where(keep)
    if ts is None:
        return found
    return found.orderBy(F.desc(ts), tie) if tie else found.orderBy(F.desc(ts))


OPERATORS = {
    "=": lambda column, value: column == value,
    "!=": lambda column, value: column != value,
    "<": lambda column, value: column < value,
    "<=": lambda column, value: column <= value,
    ">": lambda column, value: column > value,
    ">=": lambda column, value: column >= value,
    "=~": lambda column, value: column.rlike(value),
    "!~": lambda column, value: ~column.rlike(value),
}


def adhoc_filter(df: DataFrame, terms: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet every (column, operator, value) term; values are literals, never query text."""
    for column, operator, value in terms:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator}")
        literal = value if operator in ("=~", "!~") else F.lit(value)
        df = df.where(OPERATORS[operator](F.col(column), literal))
    return df


def context_search(
    df: DataFrame, key: str, text: str, pattern: str, before: int = 5, after: int = 5, comment: str = COMMENT_LINE
) -> DataFrame:
    """Lines that match ``pattern``, whatever the case, and their neighbours; blank lines are left out.

    Comment lines are dropped first and do not count as neighbours. A text is one row, so all of this stays inside the
    row: nothing is shuffled. ``_near`` holds, per line, whether a match lies in its reach; it is built by doubling the
    reach of an array of marks.
    """
    width = before + after + 1
    out = df.select(
        key,
        F.filter(F.split(F.col(text), "\\r?\\n"), lambda line: ~line.rlike(comment)).alias("_lines"),
    )
    out = out.withColumn("_hits", F.transform("_lines", lambda line: line.rlike("(?i)" + pattern).cast("int")))
    out = out.withColumn(
        "_near",
        F.concat(F.array_repeat(F.lit(0), before), F.col("_hits"), F.array_repeat(F.lit(0), after)),
    )
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        moved = F.slice("_near", F.lit(step + 1), F.greatest(F.size("_near") - step, F.lit(0)))
        out = out.withColumn("_near", F.zip_with("_near", moved, lambda a, b: F.greatest(a, b)))
        reach += step
    lines = F.arrays_zip(
        F.col("_lines").alias("line"),
        F.col("_hits").alias("hit"),
        F.slice("_near", F.lit(1), F.size("_lines")).alias("near"),
    )
    flat = out.select(key, F.posexplode(lines).alias("_pos", "_line"))
    return flat.where((F.col("_line.near") == 1) & F.col("_line.line").rlike("\\S")).select(
        key,
        (F.col("_pos") + 1).cast("bigint").alias("line_no"),
        F.col("_line.line").alias("line"),
        (F.col("_line.hit") == 1).alias("is_match"),
    )


def tail(df: DataFrame, keys: Sequence[str], line_no: str, n: int) -> DataFrame:
    """The last ``n`` lines of each file."""
    return first_n(df, keys, [F.desc(line_no)], n, spread=line_no)


def progress(
    df: DataFrame,
    run: Sequence[str],
    order: Sequence[str],
    every: int = FRAMES_PER_MESSAGE,
    text: str = PROGRESS_TEXT,
) -> DataFrame:
    """Every ``every``-th frame of a run, with the running count and a message; other frames are dropped."""
    counted = numbered(df, run, order, "frame_count")
    return counted.where(F.col("frame_count") % every == 0).withColumn(
        "message", F.format_string(text, F.col("frame_count"))
    )


def service_edges(df: DataFrame, trace: str, span: str, parent: str, service: str) -> DataFrame:
    """Calls between services: child spans counted by caller and callee.

    Children are counted per parent span before the join, so a parent with very many children joins as a few rows.
    """
    children = (
        df.where(F.col(parent).isNotNull())
        .groupBy(F.col(trace).alias("_trace"), F.col(parent).alias("_span"), F.col(service).alias("callee"))
        .agg(F.count(F.lit(1)).alias("_calls"))
    )
    parents = df.select(F.col(trace).alias("_trace"), F.col(span).alias("_span"), F.col(service).alias("caller"))
    return (
        children.join(parents, ["_trace", "_span"])
        .groupBy("caller", "callee")
        .agg(F.sum("_calls").alias("n_calls"))
    )


def daily_index(ts: Column, prefix: str = "logs-otel-") -> Column:
    """The name of the index of a day."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyy.MM.dd"))


def newest_document(df: DataFrame, key: Sequence[str], at: str, tie: str) -> DataFrame:
    """Upsert: of all versions of a document the last written one."""
    return first_n(df, key, [F.desc(at), F.desc(tie)], 1)
