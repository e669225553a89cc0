"""The shape of the plans."""

from __future__ import annotations

import re

import pytest

from labspark.workload import QUERIES

BATCH = sorted(n for n in QUERIES if not n.startswith("stream_") and n != "metric_ingest_stream")
SHUFFLES = {
    "prefix_frequency": 1,
    "counter_increase": 1,
    "counter_rate": 1,
    "gauge_last_per_step": 1,
    "load_pivot": 1,
    "newest_per_group": 1,
    "log_tail_n": 1,
    "all_ready_rollup": 1,
    "context_search": 0,
    "tags_to_columns": 0,
    "message_clean": 0,
    "log_json_parse": 0,
}


#: These number rows over a checkpoint, which a plan shows as an RDD.
NUMBERED = {"contact_points", "network_infrastructure", "progress_sample", "state_document", "state_hosts"}


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_nested_loops(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for bad in ("NestedLoop", "Cartesian", "EvalPython", "InPandas", "InArrow", "ExistingRDD"):
        assert bad not in plan or (bad == "ExistingRDD" and name in NUMBERED)
    if name in SHUFFLES:
        assert len(re.findall(r"[-+] Exchange", plan)) == SHUFFLES[name]


def test_filters_reach_the_scan(spark, sf):
    plan = QUERIES["relative_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,ScalarSubquery" in plan
    plan = QUERIES["name_glob"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(c_name,Customer#0)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
