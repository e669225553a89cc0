"""Column functions against plain Python on generated texts; one Spark job per round."""

from __future__ import annotations

import fnmatch
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labspark.functions import text as TX
from labspark.operators.prefix import prefix_frequency

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
texts = st.lists(st.text(alphabet="ab-_.%*\\ \t\n\r\x1b[0;31mé  ", max_size=14), min_size=1, max_size=60)
SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f  "


def column(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


def plain_clean(message):
    bare = re.sub("\x1b\\[[0-9;]*[a-zA-Z]", "", message)
    return re.sub(r"\s+", " ", re.sub("[\r\n]+", " ", bare).strip(SPACE), flags=re.ASCII)


@few
@given(texts)
def test_clean_message(spark, rows):
    assert column(spark, rows, TX.clean_message) == [plain_clean(r) for r in rows]


@few
@given(texts)
def test_name_type(spark, rows):
    want = [p[-3] if len(p := r.split("-")) >= 4 else "unknown" for r in rows]
    assert column(spark, rows, TX.name_type) == want


def plain_glob(name, pattern):
    escaped = "".join(c if c == "*" else f"[{c}]" if c in "[?" else c for c in pattern)
    return fnmatch.fnmatchcase(name, escaped)


@few
@given(texts, st.text(alphabet="ab-_.%*\\", max_size=6))
def test_globs(spark, rows, pattern):
    want = [plain_glob(r, pattern) for r in rows]
    assert column(spark, rows, lambda c: TX.glob(c, pattern)) == want
    assert column(spark, rows, lambda c: TX.any_glob(c, [pattern, "a*"])) == [
        plain_glob(r, pattern) or r.startswith("a") for r in rows
    ]


@few
@given(texts, st.integers(1, 5))
def test_prefixes(spark, rows, length):
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    want = {}
    for r in rows:
        want[r[:length]] = want.get(r[:length], 0) + 1
    assert {r["prefix"]: r["frequency"] for r in prefix_frequency(df, length=length).collect()} == want
