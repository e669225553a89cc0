from __future__ import annotations

import json

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from labspark.operators import paths as P


def frame(spark, documents: list, first: int = 0):
    rows = [(first + i, None if d is None else d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "id bigint, body string")


def flat(spark, document) -> dict:
    return {row.path: json.loads(row.value) for row in P.flatten(frame(spark, [document]), ["id"]).collect()}


def merged(spark, base: list, patch: list) -> dict:
    rows = P.merge_documents(frame(spark, base), frame(spark, patch), ["id"]).collect()
    return {row.id: json.loads(row.body) for row in rows}


def deep_merge(base, patch):
    if not (isinstance(base, dict) and isinstance(patch, dict)):
        return patch
    out = dict(base)
    for key, value in patch.items():
        out[key] = deep_merge(base[key], value) if key in base else value
    return out


def nested(depth: int) -> dict:
    return {"k": nested(depth - 1), "n": depth} if depth else {"leaf": [1, {"x": {}}]}


def test_paths_of_a_document(spark):
    document = {"a": {"b.c": 1, "50%": {"d": []}}, "e": {}, "": None, "l": [{"m": 1}], "it's \"q\"": "v.w"}
    assert flat(spark, document) == {
        "$.a.b%2Ec": 1, "$.a.50%25.d": [], "$.e": {}, "$.": None, "$.l": [{"m": 1}], "$.it's \"q\"": "v.w"
    }
    assert flat(spark, [1, {"a": 2}]) == {"$": [1, {"a": 2}]}
    assert flat(spark, {}) == {"$": {}}


def test_bodies_without_paths(spark):
    df = frame(spark, [None, '{"a":', "", {"a": 1}])
    assert [(row.id, row.path) for row in P.flatten(df, ["id"]).collect()] == [(3, "$.a")]
    assert P.rebuild(P.flatten(frame(spark, []), ["id"]), ["id"]).count() == 0


def test_any_depth_comes_back(spark):
    documents = [nested(depth) for depth in (0, 1, 3, 4, 5, 9, 17)]
    found = P.rebuild(P.flatten(frame(spark, documents), ["id"]), ["id"]).collect()
    assert {row.id: json.loads(row.body) for row in found} == dict(enumerate(documents))


def test_merge_by_hand(spark):
    cases = [
        ({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {"a": {"b": 3, "c": 2}}),
        ({"a": [1, 2, 3]}, {"a": [9]}, {"a": [9]}),
        ({"a": {"b": 1}}, {"a": 5}, {"a": 5}),
        ({"a": 5}, {"a": {"b": 1}}, {"a": {"b": 1}}),
        ({"a": {"b": 1}}, {"a": {}}, {"a": {"b": 1}}),
        ({"a": 1}, {"a": {}}, {"a": {}}),
        ({"a": {}}, {"a": {"b": {}}}, {"a": {"b": {}}}),
        ({"a": 1}, {"a": None}, {"a": None}),
        ({"a": 1}, {}, {"a": 1}),
        ({}, {}, {}),
        ({"a": 1}, [2], [2]),
        ([2], {"a": 1}, {"a": 1}),
        ({"a": 1}, '{"a":', {"a": 1}),
        (None, {"a": 1}, {"a": 1}),
    ]
    found = merged(spark, [c[0] for c in cases], [c[1] for c in cases])
    assert found == {i: wanted for i, (_, _, wanted) in enumerate(cases)}


def test_documents_of_one_side(spark):
    rows = P.merge_documents(frame(spark, [{"a": 1}]), frame(spark, [{"b": 2}], first=1), ["id"]).collect()
    assert {row.id: json.loads(row.body) for row in rows} == {0: {"a": 1}, 1: {"b": 2}}


def test_keys_come_in_order(spark):
    body = P.rebuild(P.flatten(frame(spark, [{"b": 1, "a": {"d": 2, "c": "x"}}]), ["id"]), ["id"]).first().body
    assert body == '{"a":{"c":"x","d":2},"b":1}'


names = st.text("ab.%2E\"'é\\ ", max_size=3)
leaves = st.none() | st.booleans() | st.integers(-99, 99) | st.text("ab\"\\é\n", max_size=4)
values = st.recursive(leaves, lambda inner: st.lists(inner, max_size=2) | st.dictionaries(names, inner, max_size=3), max_leaves=10)
documents = st.lists(st.tuples(st.dictionaries(names, values, max_size=4), values), min_size=15, max_size=30)


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(documents)
def test_merge_against_a_recursive_one(spark, pairs):
    found = merged(spark, [json.dumps(base) for base, _ in pairs], [json.dumps(patch) for _, patch in pairs])
    assert found == {i: deep_merge(base, patch) for i, (base, patch) in enumerate(pairs)}
