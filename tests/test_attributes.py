from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labspark.operators import attributes as A
from labspark.session import scratch_path

BODIES = [
    (1, '{"a": 1, "b": {"c": [1, 2, "x"]}, "d.e": null, "it\'s": true}'),
    (2, '{"a": '),
    (3, None),
    (4, '[1, {"z": 1.5}]'),
    (5, "7"),
    (6, '{"a": 1, "a": 2}'),
    (7, '{"a": "é q", "n": -2.5e3}'),
    (8, ""),
    (9, "{}"),
]


def parsed(spark, rows=BODIES):
    return A.parse(spark.createDataFrame(rows, "id bigint, body string"))


def test_bad_bodies_are_kept(spark):
    found = {row.id: (row.malformed, row.none, row.body) for row in parsed(spark).withColumn("none", F.col("attributes").isNull()).collect()}
    assert {i for i, (bad, _, _) in found.items() if bad} == {2, 6, 8}
    assert {i for i, (_, none, _) in found.items() if none} == {2, 3, 6, 8}
    assert {i: body for i, (_, _, body) in found.items()} == dict(BODIES)


def test_attributes_of_any_key(spark):
    df = parsed(spark)
    cases = [
        (["b", "c", 2], "string", {1: "x"}),
        (["d.e"], "string", {}),
        (["it's"], "boolean", {1: True}),
        (["a"], "bigint", {1: 1}),
        (["a"], "string", {1: "1", 7: "é q"}),
        ([1, "z"], "double", {4: 1.5}),
        (["n"], "double", {7: -2500.0}),
    ]
    for keys, kind, wanted in cases:
        rows = df.select("id", A.attribute("attributes", keys, kind).alias("v")).where("v is not null").collect()
        assert {row.id: row.v for row in rows} == wanted
    with pytest.raises(ValueError):
        A.attribute("attributes", ["a\"b'c"])


def test_search_compares_by_type(spark):
    df = parsed(spark)
    for terms, wanted in [
        ([(["a"], "=", 1)], {1}),
        ([(["a"], "!=", "1")], {7}),
        ([(["a"], "=~", "^.")], {1, 7}),
        ([(["a"], "!~", "q$")], {1}),
        ([(["n"], "<", 0.0), (["a"], "!=", "x")], {7}),
        ([(["it's"], "=", True)], {1}),
        ([], set(range(1, 10))),
    ]:
        assert {row.id for row in A.search(df, terms).collect()} == wanted
    with pytest.raises(ValueError):
        A.search(df, [(["a"], "like", "x")])


def test_listed_rows(spark):
    found = sorted(map(tuple, A.listed(parsed(spark), ["id", "malformed"]).collect()), key=repr)
    assert found == sorted(
        [
            (1, False, "a", "number", "1"),
            (1, False, "b", "object", None),
            (1, False, "d.e", "null", None),
            (1, False, "it's", "boolean", "true"),
            (2, True, None, None, None),
            (3, False, None, None, None),
            (4, False, None, None, None),
            (5, False, None, None, None),
            (6, True, None, None, None),
            (7, False, "a", "string", "é q"),
            (7, False, "n", "number", "-2500.0"),
            (8, True, None, None, None),
            (9, False, None, None, None),
        ],
        key=repr,
    )


def test_key_profile(spark):
    found = {(row.key, row.kind): row.n_rows for row in A.key_profile(parsed(spark)).collect()}
    assert found == {
        ("a", "number"): 1, ("a", "string"): 1, ("b", "object"): 1, ("d.e", "null"): 1, ("it's", "boolean"): 1, ("n", "number"): 1
    }


def test_empty_tables(spark):
    empty = parsed(spark, [])
    assert A.listed(empty, ["id"]).count() == 0 and A.key_profile(empty).count() == 0


def test_stored_searches_read_the_fields_asked_for(spark):
    path = scratch_path(spark, "attributes-test")
    parsed(spark).drop("body").write.parquet(path)
    stored = spark.read.parquet(path)
    found = A.search(stored, [(["a"], "=", 1)]).select("id", A.attribute("attributes", ["b", "c", 0], "bigint").alias("c"))
    assert [tuple(row) for row in found.collect()] == [(1, 1)]
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(attributes.`" in plan
    read = next(line for line in plan.splitlines() if "ReadSchema" in line).split("ReadSchema")[1]
    assert "attributes:struct<" in read and read.count("bigint") >= 2 and "attributes:variant" not in read


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("ab.\"é '", max_size=3), inner, max_size=3),
    max_leaves=8,
)


def kind(value: object) -> str:
    for of, name in ((dict, "object"), (list, "array"), (str, "string"), (bool, "boolean"), (int, "number")):
        if isinstance(value, of):
            return name
    return "null"


@settings(max_examples=5, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text("ab.\"é '", min_size=1, max_size=3), values, max_size=4), min_size=20, max_size=40))
def test_listing_against_json(spark, objects):
    rows = [(i, json.dumps(o)) for i, o in enumerate(objects)]
    found = {(r.id, r.key): (r.kind, r.value) for r in A.listed(parsed(spark, rows), ["id"]).collect()}
    wanted = {}
    for i, o in enumerate(objects):
        for key, value in o.items():
            scalar = isinstance(value, (str, bool, int))
            text = value if isinstance(value, str) else json.dumps(value)
            wanted[i, key] = (kind(value), text if scalar else None)
        if not o:
            wanted[i, None] = (None, None)
    assert found == wanted
