from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from labspark.operators import hosts as H
from labspark.operators import resources as R

HOST = "cluster_id string, server_type string, alias string, public_ip string, private_ip string"
BASE = [
    ("c", "db", "db0", "54.1.2.3", "10.0.0.1"),
    ("c", "db", "db1", "54.1.2.4", "10.0.0.2"),
    ("c", "control", "control0", "54.1.2.5", "10.0.0.3"),
]
COLUMNS = ["server_type", "alias", "public_ip"]


def verdict(spark, current):
    stored = spark.createDataFrame(BASE, HOST)
    return H.reconcile(stored, spark.createDataFrame(current, HOST), "cluster_id", COLUMNS).first()


def test_reconcile_ignores_private_addresses(spark):
    assert verdict(spark, [(*r[:4], "10.9.9.9") for r in reversed(BASE)])["hosts_match"]


@pytest.mark.parametrize(
    "current",
    [
        [*BASE[:2], ("c", "control", "control0", "54.9.9.9", None)],
        [*BASE[:2], ("c", "control", "control1", "54.1.2.5", None)],
        BASE[:2],
        [*BASE, BASE[0]],
        [*BASE[:2], ("c", "app", "control0", "54.1.2.5", None)],
    ],
)
def test_reconcile_finds_differences(spark, current):
    assert not verdict(spark, current)["hosts_match"]


def test_reconcile_treats_absent_addresses_as_equal(spark):
    df = spark.createDataFrame([("c", "db", "db0", None, None)], HOST)
    assert H.reconcile(df, df, "cluster_id", COLUMNS).first()["hosts_match"]


def test_reservations_become_rows_and_bad_instances_are_named(spark):
    schema = (
        "reservation string, instances array<struct<instance_id: string, state: string, "
        "tags: array<struct<key: string, value: string>>>>"
    )

    def instance(name, **tags):
        return (name, "running", [(k, v) for k, v in tags.items()])

    twice = ("i-4", "running", [("ServerType", "app"), ("Name", "x0"), ("ServerType", "db"), ("Name", "db9")])
    df = spark.createDataFrame(
        [
            ("r1", [instance("i-1", ServerType="db", Name="db0"), instance("i-2", Name="no-type")]),
            ("r2", [instance("i-3", ServerType="mystery", Name="m0"), twice]),
        ],
        schema,
    )
    flat = H.flatten_reservations(df).select(
        "instance_id", F.col("tag_map")["ServerType"].alias("server_type"), F.col("tag_map")["Name"].alias("alias")
    )
    known = spark.createDataFrame([(t,) for t in H.SERVER_TYPES.values()], "server_type string")
    checked = H.check_required(flat, ["server_type", "alias"], "server_type", known)
    found = {r["instance_id"]: (r["alias"], r["verdict"]) for r in checked.collect()}
    assert found == {
        "i-1": ("db0", "accepted"),
        "i-2": ("no-type", "missing_tags"),
        "i-3": ("m0", "unknown_type"),
        "i-4": ("db9", "accepted"),
    }


@pytest.mark.parametrize(
    ("configured", "existing", "needed", "step"),
    [(3, 0, 3, "create"), (3, 1, 2, "create"), (1, 3, -2, "enough"), (2, 2, 0, "enough"), (0, 0, 0, "none"), (0, 2, -2, "none")],
)
def test_capacity(spark, configured, existing, needed, step):
    wanted = spark.createDataFrame([("db", configured)], "server_type string, configured_count int")
    found = spark.createDataFrame([("db",)] * existing, "server_type string")
    row = H.capacity_gap(wanted, found, ["server_type"], "configured_count").first()
    assert (row["needed_count"], row["step"]) == (needed, step)


def test_placement_continues_the_index_and_takes_subnets_in_turn(spark):
    wanted = spark.createDataFrame([("db", 4), ("app", 1), ("control", 1)], "server_type string, configured_count int")
    found = spark.createDataFrame([("db",), ("app",), ("app",), ("control",)], "server_type string")
    gaps = H.capacity_gap(wanted, found, ["server_type"], "configured_count")
    placed = H.place_missing(gaps, "server_type", "configured_count", F.array(F.lit("a"), F.lit("b")))
    rows = [(r["alias"], r["subnet"]) for r in placed.orderBy("host_index").collect()]
    assert rows == [("db1", "b"), ("db2", "a"), ("db3", "b")]


def test_live_state_and_refresh(spark):
    stored = spark.createDataFrame([("i-1", "1.1.1.1"), ("i-2", "2.2.2.2"), ("i-3", None)], "id string, ip string")
    live = spark.createDataFrame([("i-1", "9.9.9.9", "running"), ("i-2", None, "stopped")], "id string, ip string, state string")
    states = {r["id"]: r["live_state"] for r in H.live_state(stored, live, "id").collect()}
    assert states == {"i-1": "RUNNING", "i-2": "STOPPED", "i-3": "UNKNOWN"}
    fresh = {r["id"]: (r["ip"], r["drifted"]) for r in H.refresh(stored, live, "id", ["ip"]).collect()}
    assert fresh == {"i-1": ("9.9.9.9", True), "i-2": ("2.2.2.2", False), "i-3": (None, False)}


def test_readiness(spark):
    rows = [("a", "running", "1"), ("a", "running", ""), ("b", "running", "1"), ("c", "pending", None)]
    df = spark.createDataFrame(rows, "cluster string, state string, public_ip string")
    found = {r["cluster"]: (r["all_ready"], r["n_running"], r["n_addressed"]) for r in H.readiness(df, "cluster").collect()}
    assert found == {"a": (False, 2, 1), "b": (True, 1, 1), "c": (False, 0, 0)}


def test_host_lists(spark):
    df = spark.createDataFrame([("db0",), ("db1",), ("db2",)], "alias string")
    assert [r[0] for r in H.pick_hosts(df, "alias", "db1,, ,db2").orderBy("alias").collect()] == ["db1", "db2"]
    assert H.pick_hosts(df, "alias", " , ").count() == 3
    assert H.pick_hosts(df, "alias", spark.createDataFrame([("db0",)], "alias string")).count() == 1


def test_alias_lookup_prefers_the_first_type(spark):
    rows = [("x", "control", "i-1"), ("x", "app", "i-2"), ("y", "control", "i-3"), ("x", "db", "i-5"), ("x", "db", "i-4")]
    df = spark.createDataFrame(rows, "alias string, server_type string, id string")
    found = {r["alias"]: r["id"] for r in H.resolve_alias(df, "alias", "server_type", "id").collect()}
    assert found == {"x": "i-4", "y": "i-3"}


@pytest.mark.parametrize("length", [10_000, 3])
def test_documents_and_contact_points_hold_every_host(spark, length):
    rows = [("big", "db" if i % 2 else "app", f"h{i:02d}", f"10.0.0.{i}") for i in range(20)] + [("small", "db", "z", "1.1.1.1")]
    df = spark.createDataFrame(rows, "cluster string, server_type string, alias string, ip string")
    points = H.contact_points(df, "cluster", "alias", "ip", length).orderBy("cluster", "page").collect()
    # Pages joined by number are the same text for every length.
    assert ",".join(r["contact_points"] for r in points if r["cluster"] == "big") == ",".join(f"10.0.0.{i}" for i in range(20))
    assert [r["contact_points"] for r in points if r["cluster"] == "small"] == ["1.1.1.1"]
    assert {r["n_hosts"] for r in points if r["cluster"] == "big"} == ({20} if length > 20 else {3, 2})
    documents = H.state_documents(df, "cluster", "server_type", ["alias", "ip"], page_length=length).orderBy("page").collect()
    joined = [h["alias"] for r in documents if r["cluster"] == "big" for h in r["hosts"].get("db", [])]
    assert joined == [f"h{i:02d}" for i in range(20) if i % 2]
    hosts = [(r["cluster"], kind, h["alias"], h["ip"]) for r in documents for kind, list_ in r["hosts"].items() for h in list_]
    assert sorted(hosts) == sorted(rows)
    for r in documents:
        for list_ in r["hosts"].values():
            assert [h["alias"] for h in list_] == sorted(h["alias"] for h in list_)


def test_state_from_network_tags(spark):
    schema = "vpc_id string, tags array<struct<key: string, value: string>>"
    documents = spark.createDataFrame([Row(cluster_id="abc", page=0)])
    good = spark.createDataFrame([("vpc-1", [("ClusterId", "abc")]), ("vpc-2", [("ClusterId", "d"), ("Name", "lab")])], schema)
    found = {r["vpc_id"]: (r["name"], r["page"]) for r in H.rebuild_state(good, documents).collect()}
    assert found == {"vpc-1": ("recovered-cluster", 0), "vpc-2": ("lab", None)}
    bad = spark.createDataFrame([("vpc-3", [("Name", "lab")])], schema)
    with pytest.raises(Exception, match="no ClusterId tag on vpc-3"):
        H.rebuild_state(bad, documents).collect()


def test_tag_columns_take_the_last_value(spark):
    df = spark.createDataFrame([([("a", "1"), ("a", "2")],), ([],), (None,)], "tags array<struct<key: string, value: string>>")
    rows = H.tags_to_columns(df, "tags", {"a": ("a", None), "b": ("b", "none")}).collect()
    assert [(r["a"], r["b"]) for r in rows] == [("2", "none"), (None, "none"), (None, "none")]


def test_resources(spark):
    ids = spark.createDataFrame([("v1", "i"), ("v1", "j")], "vpc string, id string")
    tables = spark.createDataFrame([("v1", "r"), ("v2", "r")], "vpc string, id string")
    all_ = R.inventory({"instance": (ids, "vpc", "id"), "route_table": (tables, "vpc", "id")})
    rows = {r["vpc_id"]: r for r in R.resource_summary(all_, ["instance", "route_table"]).collect()}
    assert (rows["v1"]["n_instance"], rows["v1"]["has_resources"]) == (2, True)
    assert (rows["v2"]["n_instance"], rows["v2"]["has_resources"]) == (0, False)
    counts = {(r["vpc_id"], r["resource_type"]): r["n_resources"] for r in R.resource_counts(all_).collect()}
    assert counts == {("v1", "instance"): 2, ("v1", "route_table"): 1, ("v2", "route_table"): 1}


def test_overlap(spark):
    df = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["c"]), (3, [])], "id int, ids array<string>")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "subnet string")
    assert [r[0] for r in R.overlapping(df, ["id"], "ids", wanted).collect()] == [1]
    assert [r[0] for r in R.overlapping(df, ["id"], "ids", ["c", "x"]).collect()] == [2]
    assert R.overlapping(df, ["id"], "ids", []).count() == 0
    assert R.overlapping(df, ["id"], "ids", wanted.where("false")).count() == 0


def test_firewall_rules(spark):
    schema = (
        "from_port int, to_port int, protocol string, ranges array<struct<cidr: string, description: string>>"
    )
    rows = [
        (22, 22, "tcp", [("0.0.0.0/0", None), (None, None)]),
        (None, None, "-1", [("10.0.0.0/8", None)]),
        (1, 9, "udp", [("1.1.1.1/32", "first"), ("2.2.2.2/32", "second")]),
        (9042, 9042, "tcp", []),
    ]
    flat = R.flatten_rules(spark.createDataFrame(rows, schema))
    found = {r["cidr"]: (r["protocol_text"], r["description"]) for r in flat.collect()}
    assert found == {
        "0.0.0.0/0": ("TCP", "SSH"),
        "10.0.0.0/8": ("All", "All traffic"),
        "1.1.1.1/32": ("UDP", "first"),
        "2.2.2.2/32": ("UDP", "first"),
    }
    wanted = spark.createDataFrame(
        [(22, 22, "tcp", "0.0.0.0/0"), (22, 23, "tcp", "0.0.0.0/0"), (None, None, "-1", "10.0.0.0/8"), (22, 22, "udp", "0.0.0.0/0")],
        "from_port int, to_port int, protocol string, cidr string",
    )
    missing = sorted((r["to_port"], r["protocol"]) for r in R.missing_rules(wanted, flat).collect())
    assert missing == [(22, "udp"), (23, "tcp")]


def test_exclusions_and_first_tagged(spark):
    df = spark.createDataFrame([("default", 1), ("mine", 2), (None, 3)], "name string, id int")
    assert sorted(r["id"] for r in R.without_default(df, "name").collect()) == [2, 3]
    assert R.without_default(df, "name", include_default=True).count() == 3
    named = spark.createDataFrame([("lab-b", True), ("lab-a", False), ("lab-c", True), ("x", True)], "name string, ok boolean")
    assert R.first_with_tag(named, "name", "lab-", F.col("ok")).first()["name"] == "lab-b"


@pytest.mark.parametrize("length", [10_000, 2])
def test_infrastructure_of_a_network(spark, length):
    rows = [("v", "subnet", f"s{i}") for i in range(9)] + [("v", "security_group", "g2"), ("v", "security_group", "g1")]
    rows.append(("w", "internet_gateway", "gw"))
    df = spark.createDataFrame(rows, "vpc_id string, resource_type string, resource_id string")
    found = R.infrastructure(df, length).where("vpc_id = 'v'").orderBy("page").collect()
    assert [s for r in found for s in r["subnet_ids"]] == [f"s{i}" for i in range(9)]
    assert {(r["security_group_id"], r["internet_gateway_id"]) for r in found} == {("g1", None)}
    bare = R.infrastructure(df, length).where("vpc_id = 'w'").collect()
    assert [tuple(r) for r in bare] == [("w", 0, [], None, "gw")]
