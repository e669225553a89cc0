"""Host operators over customers, suppliers, nations, orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.functions.labels import has_any_tag, non_null_ids, none_of, node_ready, roles
from labspark.functions.status import (
    is_active_cluster,
    is_ready_cluster,
    is_terminal_step,
    is_terminated_cluster,
)
from labspark.operators import hosts as H
from labspark.operators import images as I
from labspark.operators import resources as R
from labspark.sources import state
from labspark.workload.registry import query, table


def _state(status: str = "o_orderstatus") -> Column:
    return F.when(F.col(status) == "O", "running").when(F.col(status) == "F", "stopped").otherwise("pending")


STATE = "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'stopped' ELSE 'pending' END"


@query(
    "live_state_left_join",
    f"""SELECT c_custkey AS instance_id, c_name AS alias, upper(coalesce(state, 'UNKNOWN')) AS live_state
        FROM customer LEFT JOIN (
          SELECT o_custkey, {STATE} AS state FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
          WHERE rn = 1) ON o_custkey = c_custkey""",
)
def live_state_left_join(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("instance_id"), F.col("c_name").alias("alias"))
    latest = I.newest_per_group(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    live = latest.select(F.col("o_custkey").alias("instance_id"), _state().alias("state"))
    return H.live_state(stored, live, "instance_id")


@query(
    "refresh_coalesce",
    """SELECT c_custkey AS instance_id, c_name AS alias, coalesce(kind, c_mktsegment) AS public_ip,
              kind IS NOT NULL AND kind IS DISTINCT FROM c_mktsegment AS drifted
       FROM customer LEFT JOIN (
         SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events)
         WHERE rn = 1) ON user_id = c_custkey""",
)
def refresh_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("instance_id"), F.col("c_name").alias("alias"), F.col("c_mktsegment").alias("public_ip")
    )
    latest = I.newest_per_group(table(spark, sf, "events"), ["user_id"], "ts", "event_id")
    seen = F.when(F.col("event_type") != "error", F.col("event_type"))
    live = latest.select(F.col("user_id").alias("instance_id"), seen.alias("public_ip"))
    return H.refresh(stored, live, "instance_id", ["public_ip"])


WANTED = "(SELECT n_nationkey AS place, n_name AS server_type, n_nationkey % 9 AS configured_count FROM nation)"
GAPS = f"""(SELECT w.*, coalesce(n, 0) AS existing_count, configured_count::bigint - coalesce(n, 0) AS needed_count
    FROM {WANTED} w LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = place)"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("place"),
        F.col("n_name").alias("server_type"),
        (F.col("n_nationkey") % 9).alias("configured_count"),
    )
    existing = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("place"))
    return H.capacity_gap(wanted, existing, ["place"], "configured_count")


@query(
    "capacity_gap",
    f"""SELECT *, CASE WHEN needed_count > 0 THEN 'create'
                      WHEN configured_count > 0 AND existing_count > 0 THEN 'enough' ELSE 'none' END AS step
        FROM {GAPS}""",
)
def capacity_gap(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(spark, sf)


@query(
    "placement_round_robin",
    f"""SELECT server_type, host_index, server_type || host_index AS alias,
               ['subnet-a', 'subnet-b', 'subnet-c'][host_index % 3 + 1] AS subnet
        FROM (SELECT server_type, unnest(range(existing_count, configured_count::bigint)) AS host_index
              FROM {GAPS} WHERE needed_count > 0)""",
)
def placement_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    subnets = F.array(F.lit("subnet-a"), F.lit("subnet-b"), F.lit("subnet-c"))
    placed = H.place_missing(gaps(spark, sf), "server_type", "configured_count", subnets)
    return placed.select("server_type", "host_index", "alias", "subnet")


STORED = """(SELECT o_custkey AS cluster_id, o_orderstatus AS server_type, o_orderkey AS alias,
                    o_orderpriority AS public_ip FROM orders)"""
CURRENT = """(SELECT cluster_id, server_type, alias,
                     CASE WHEN alias % 97 = 0 THEN 'moved' ELSE public_ip END AS public_ip
              FROM STORED_TABLE WHERE alias % 211 <> 3)""".replace("STORED_TABLE", STORED)


@query(
    "snapshot_reconcile",
    f"""SELECT cluster_id, sum(a)::bigint AS n_stored, sum(b)::bigint AS n_current,
               count(*) FILTER (a <> b) AS n_different, NOT bool_or(a <> b) AS hosts_match
        FROM (SELECT cluster_id, server_type, alias, public_ip, sum(a) AS a, sum(b) AS b FROM (
                SELECT *, 1 AS a, 0 AS b FROM {STORED} UNION ALL SELECT *, 0, 1 FROM {CURRENT}) GROUP BY ALL)
        GROUP BY cluster_id""",
)
def snapshot_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cluster_id"),
        F.col("o_orderstatus").alias("server_type"),
        F.col("o_orderkey").alias("alias"),
        F.col("o_orderpriority").alias("public_ip"),
    )
    moved = F.when(F.col("alias") % 97 == 0, "moved").otherwise(F.col("public_ip"))
    current = stored.where(F.col("alias") % 211 != 3).withColumn("public_ip", moved)
    return H.reconcile(stored, current, "cluster_id", ["server_type", "alias", "public_ip"])


@query(
    "required_tags_join",
    """SELECT instance_id, alias, server_type, n_regionkey AS region,
         CASE WHEN alias IS NULL OR server_type IS NULL THEN 'missing_tags'
              WHEN n_name IS NULL THEN 'unknown_type' ELSE 'accepted' END AS verdict
       FROM (SELECT c_custkey AS instance_id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS alias,
                    CASE WHEN c_custkey % 11 <> 0 THEN 'NATION_' || (c_nationkey * 2) END AS server_type FROM customer)
       LEFT JOIN nation ON n_name = server_type""",
)
def required_tags_join(spark: SparkSession, sf: str) -> DataFrame:
    instances = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("instance_id"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("alias"),
        F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("NATION_"), F.col("c_nationkey") * 2)).alias("server_type"),
    )
    known = table(spark, sf, "nation").select(F.col("n_name").alias("server_type"), F.col("n_regionkey").alias("region"))
    checked = H.check_required(instances, ["alias", "server_type"], "server_type", known)
    return checked.select("instance_id", "alias", "server_type", "region", "verdict")


@query(
    "host_list_filter",
    """SELECT s_suppkey, s_name FROM supplier
       WHERE s_name IN ('Supplier#000000003', 'Supplier#000000007', 'Supplier#000000042')""",
)
def host_list_filter(spark: SparkSession, sf: str) -> DataFrame:
    names = "Supplier#000000003,Supplier#000000007,, ,Supplier#000000042"
    return H.pick_hosts(table(spark, sf, "supplier"), "s_name", names).select("s_suppkey", "s_name")


@query(
    "all_ready_rollup",
    f"""SELECT o_custkey AS cluster_id,
          bool_and({STATE} = 'running' AND public_ip <> '') AS all_ready,
          count(*) FILTER ({STATE} = 'running') AS n_running,
          count(*) FILTER (public_ip <> '') AS n_addressed, count(*) AS n_instances
        FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS public_ip FROM orders)
        GROUP BY 1""",
)
def all_ready_rollup(spark: SparkSession, sf: str) -> DataFrame:
    instances = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cluster_id"),
        _state().alias("state"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("public_ip"),
    )
    return H.readiness(instances, "cluster_id")


HOSTS = """(SELECT s_nationkey AS cluster_id, s_suppkey AS instance_id, 's' || lpad(s_suppkey::varchar, 9, '0') AS alias,
                   ['db', 'app', 'control'][s_suppkey % 3 + 1] AS server_type FROM supplier)"""


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(F.lit("db"), F.lit("app"), F.lit("control"))
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("cluster_id"),
        F.col("s_suppkey").alias("instance_id"),
        F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("alias"),
        F.get(kinds, (F.col("s_suppkey") % 3).cast("int")).alias("server_type"),
    )


@query(
    "state_document",
    f"""SELECT cluster_id, page,
          to_json({{'clusterId': cluster_id, 'hosts': map_from_entries(list((server_type, hosts) ORDER BY server_type))}})::varchar
            AS document
        FROM (SELECT cluster_id, page, server_type,
                     list({{'alias': alias, 'instance_id': instance_id}} ORDER BY alias) AS hosts
              FROM (SELECT *, (row_number() OVER (PARTITION BY cluster_id ORDER BY server_type, alias) - 1) // 10000 AS page
                    FROM {HOSTS}) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def state_document(spark: SparkSession, sf: str) -> DataFrame:
    documents = H.state_documents(hosts(spark, sf), "cluster_id", "server_type", ["alias", "instance_id"])
    document = F.to_json(F.struct(F.col("cluster_id").alias("clusterId"), "hosts"))
    return documents.select("cluster_id", "page", document.alias("document"))


@query(
    "contact_points",
    f"""SELECT cluster_id, (n - 1) // 10000 AS page, string_agg(instance_id::varchar, ',' ORDER BY n) AS contact_points,
               count(*) AS n_hosts
        FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY alias, instance_id::varchar) AS n FROM {HOSTS})
        GROUP BY 1, 2""",
)
def contact_points(spark: SparkSession, sf: str) -> DataFrame:
    addressed = hosts(spark, sf).withColumn("address", F.col("instance_id").cast("string"))
    return H.contact_points(addressed, "cluster_id", "alias", "address")


@query(
    "alias_resolve",
    """SELECT alias, server_type, instance_id FROM (
         SELECT *, row_number() OVER (PARTITION BY alias ORDER BY
             CASE server_type WHEN 'db' THEN 0 WHEN 'app' THEN 1 ELSE 2 END, instance_id) AS rn
         FROM (SELECT 'host' || s_suppkey AS alias, CASE WHEN s_suppkey % 2 = 0 THEN 'db' ELSE 'control' END AS server_type,
                      s_suppkey AS instance_id FROM supplier
               UNION ALL
               SELECT 'host' || (c_custkey % 500), 'app', c_custkey FROM customer)) WHERE rn = 1""",
)
def alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "supplier").select(
        F.concat(F.lit("host"), F.col("s_suppkey")).alias("alias"),
        F.when(F.col("s_suppkey") % 2 == 0, "db").otherwise("control").alias("server_type"),
        F.col("s_suppkey").alias("instance_id"),
    )
    second = table(spark, sf, "customer").select(
        F.concat(F.lit("host"), F.col("c_custkey") % 500).alias("alias"),
        F.lit("app").alias("server_type"),
        F.col("c_custkey").alias("instance_id"),
    )
    return H.resolve_alias(first.unionByName(second), "alias", "server_type", "instance_id")


@query(
    "resource_summary",
    """SELECT vpc_id, count(*) FILTER (kind = 'instance') AS n_instance, count(*) FILTER (kind = 'subnet') AS n_subnet,
              count(*) FILTER (kind = 'route_table') AS n_route_table, bool_or(kind <> 'route_table') AS has_resources
       FROM (SELECT c_nationkey::varchar AS vpc_id, 'instance' AS kind FROM customer
             UNION ALL SELECT s_nationkey::varchar, 'subnet' FROM supplier
             UNION ALL SELECT n_nationkey::varchar, 'route_table' FROM nation
             UNION ALL SELECT 'region ' || r_regionkey, 'route_table' FROM region) GROUP BY 1""",
)
def resource_summary(spark: SparkSession, sf: str) -> DataFrame:
    resources = R.inventory(
        {
            "instance": (table(spark, sf, "customer"), "c_nationkey", "c_custkey"),
            "subnet": (table(spark, sf, "supplier"), "s_nationkey", "s_suppkey"),
            "route_table": (table(spark, sf, "nation"), "n_nationkey", "n_nationkey"),
        }
    )
    # Networks that have nothing but a route table.
    network = F.concat(F.lit("region "), F.col("r_regionkey").cast("string"))
    bare = table(spark, sf, "region").withColumn("vpc_id", network)
    resources = resources.unionByName(R.inventory({"route_table": (bare, "vpc_id", "r_regionkey")}))
    return R.resource_summary(resources, ["instance", "subnet", "route_table"])


@query(
    "resource_counts",
    """SELECT vpc_id, kind AS resource_type, count(*) AS n_resources
       FROM (SELECT c_nationkey::varchar AS vpc_id, 'instance' AS kind FROM customer
             UNION ALL SELECT s_nationkey::varchar, 'subnet' FROM supplier
             UNION ALL SELECT n_nationkey::varchar, 'route_table' FROM nation) GROUP BY 1, 2""",
)
def resource_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.resource_counts(
        R.inventory(
            {
                "instance": (table(spark, sf, "customer"), "c_nationkey", "c_custkey"),
                "subnet": (table(spark, sf, "supplier"), "s_nationkey", "s_suppkey"),
                "route_table": (table(spark, sf, "nation"), "n_nationkey", "n_nationkey"),
            }
        )
    )


@query(
    "overlap_semi_join",
    """SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem, part
       WHERE p_size = 1 AND (p_partkey = l_partkey OR p_partkey = l_suppkey * 7)""",
)
def overlap_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    placed = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array("l_partkey", F.col("l_suppkey") * 7).alias("ids")
    )
    wanted = table(spark, sf, "part").where(F.col("p_size") == 1).select("p_partkey")
    return R.overlapping(placed, ["l_orderkey", "l_linenumber"], "ids", wanted)


EXISTING_RULES = """(SELECT l_linenumber AS from_port, l_linenumber + l_suppkey % 3 AS to_port,
                            l_returnflag AS protocol, l_linestatus AS cidr FROM lineitem)"""


@query(
    "missing_rules_anti_join",
    f"""SELECT o_orderkey, from_port, to_port, protocol, cidr FROM (
          SELECT o_orderkey, (o_orderkey % 9)::int AS from_port, o_orderkey % 9 + o_custkey % 5 AS to_port,
                 ['A', 'N', 'R'][o_orderkey % 3 + 1] AS protocol, o_orderstatus AS cidr FROM orders) w
        WHERE NOT EXISTS (SELECT 1 FROM {EXISTING_RULES} e WHERE e.from_port = w.from_port AND e.to_port = w.to_port
                          AND e.protocol = w.protocol AND e.cidr = w.cidr)""",
)
def missing_rules_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    permissions = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("from_port"),
        (F.col("l_linenumber") + F.col("l_suppkey") % 3).alias("to_port"),
        F.col("l_returnflag").alias("protocol"),
        F.array(
            F.struct(F.col("l_linestatus").alias("cidr"), F.lit(None).cast("string").alias("description")),
            F.struct(F.lit(None).cast("string").alias("cidr"), F.lit(None).cast("string").alias("description")),
        ).alias("ranges"),
    )
    protocols = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    wanted = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 9).cast("int").alias("from_port"),
        (F.col("o_orderkey") % 9 + F.col("o_custkey") % 5).alias("to_port"),
        F.get(protocols, (F.col("o_orderkey") % 3).cast("int")).alias("protocol"),
        F.col("o_orderstatus").alias("cidr"),
    )
    return R.missing_rules(wanted, R.flatten_rules(permissions))


@query(
    "rule_labels",
    """SELECT l_orderkey, l_linenumber, cidr, from_port, to_port, protocol_text, description FROM (
         SELECT l_orderkey, l_linenumber, from_port, to_port,
                CASE WHEN l_returnflag = 'N' THEN 'All' ELSE 'TCP' END AS protocol_text,
                coalesce(CASE WHEN l_linestatus = 'O' THEN l_shipdate::date::varchar END,
                  CASE WHEN from_port IS NULL OR to_port IS NULL THEN 'All traffic' WHEN from_port <> to_port THEN NULL
                       WHEN from_port = 22 THEN 'SSH'
                       WHEN from_port = 80 THEN 'HTTP'
                       WHEN from_port = 443 THEN 'HTTPS'
                       WHEN from_port = 3306 THEN 'MySQL'
                       WHEN from_port = 5432 THEN 'PostgreSQL'
                       WHEN from_port = 6379 THEN 'Redis'
                       WHEN from_port = 7000 THEN 'Cassandra Inter-node'
                       WHEN from_port = 7001 THEN 'Cassandra Inter-node SSL'
                       WHEN from_port = 9042 THEN 'Cassandra CQL'
                       WHEN from_port = 9142 THEN 'Cassandra CQL SSL'
                       WHEN from_port = 9160 THEN 'Cassandra Thrift'
                       WHEN from_port = 10000 THEN 'Cassandra JMX'
                       END) AS description,
                unnest([l_linestatus, CASE WHEN l_quantity > 30 THEN l_returnflag END]) AS cidr
         FROM (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE [22, 80, 443, 3306, 5432, 6379, 7000, 7001, 9042, 9142, 9160, 10000, 7199][l_orderkey % 13 + 1] END AS from_port,
                      [22, 80, 443, 3306, 5432, 6379, 7000, 7001, 9042, 9142, 9160, 10000, 7199][l_orderkey % 13 + 1]
                        + (l_partkey % 2)::int AS to_port FROM lineitem))
       WHERE cidr IS NOT NULL""",
)
def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    # All ports of the table, and one that is not in it.
    ports = F.array(*[F.lit(p) for p in (22, 80, 443, 3306, 5432, 6379, 7000, 7001, 9042, 9142, 9160, 10000, 7199)])
    port = F.get(ports, (F.col("l_orderkey") % 13).cast("int"))
    no_text = F.lit(None).cast("string")
    first_text = F.when(F.col("l_linestatus") == "O", F.col("l_shipdate").cast("date").cast("string"))
    permissions = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_suppkey") % 4 != 0, port).alias("from_port"),
        (port + (F.col("l_partkey") % 2).cast("int")).alias("to_port"),
        F.when(F.col("l_returnflag") == "N", "-1").otherwise("tcp").alias("protocol"),
        F.array(
            F.struct(F.col("l_linestatus").alias("cidr"), first_text.alias("description")),
            F.struct(F.when(F.col("l_quantity") > 30, F.col("l_returnflag")).alias("cidr"), no_text.alias("description")),
        ).alias("ranges"),
    )
    return R.flatten_rules(permissions).drop("protocol")


@query(
    "network_infrastructure",
    """SELECT n_nationkey::varchar AS vpc_id, 0::bigint AS page,
              coalesce((SELECT string_agg(s_suppkey::varchar, ',' ORDER BY s_suppkey::varchar) FROM supplier
                        WHERE s_nationkey = n_nationkey), '') AS subnet_ids,
              (SELECT min(c_custkey::varchar) FROM customer WHERE c_nationkey = n_nationkey) AS security_group_id,
              n_name AS internet_gateway_id FROM nation""",
)
def network_infrastructure(spark: SparkSession, sf: str) -> DataFrame:
    resources = R.inventory(
        {
            "subnet": (table(spark, sf, "supplier"), "s_nationkey", "s_suppkey"),
            "security_group": (table(spark, sf, "customer"), "c_nationkey", "c_custkey"),
            "internet_gateway": (table(spark, sf, "nation"), "n_nationkey", "n_name"),
        }
    )
    parts = R.infrastructure(resources)
    return parts.withColumn("subnet_ids", F.array_join("subnet_ids", ","))


@query(
    "state_hosts",
    f"""SELECT cluster_id::varchar AS cluster_id, server_type, alias, instance_id::varchar AS "instanceId",
               CASE WHEN cluster_id % 2 = 0 THEN cluster_id::int ELSE 3 END AS wanted, 'r3.2xlarge' AS instance_type
        FROM {HOSTS}""",
)
def state_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """State documents as stored text, some without all set-up options, read back leniently."""
    named = hosts(spark, sf).withColumn("instanceId", F.col("instance_id").cast("string"))
    documents = H.state_documents(named, "cluster_id", "server_type", ["alias", "instanceId"])
    options = F.struct(F.when(F.col("cluster_id") % 2 == 0, F.col("cluster_id")).alias("cassandraInstances"))
    body = F.to_json(
        F.struct(
            F.col("cluster_id").cast("string").alias("clusterId"),
            "hosts",
            options.alias("initConfig"),
            F.struct(F.lit(1).alias("x")).alias("unknownField"),
        )
    )
    states = state.parse_state(documents.select(body.alias("body")))
    rows = state.state_hosts(
        states,
        F.col("initConfig.cassandraInstances").alias("wanted"),
        F.col("initConfig.instanceType").alias("instance_type"),
    )
    return rows.select("cluster_id", "server_type", "alias", "instanceId", "wanted", "instance_type")


def tagged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with tags made of its own columns; ``flag`` appears twice."""

    def tag(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.array(
            tag("flag", F.col("l_linestatus")),
            tag("supplier", F.col("l_suppkey")),
            tag("flag", F.col("l_returnflag")),
        ).alias("tags"),
    )


@query(
    "tag_any_match",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE l_linestatus = 'R' OR l_returnflag = 'R' OR l_suppkey = 7""",
)
def tag_any_match(spark: SparkSession, sf: str) -> DataFrame:
    wanted = has_any_tag(F.col("tags"), [("flag", "R"), ("supplier", "7")])
    return tagged_lines(spark, sf).where(wanted).select("l_orderkey", "l_linenumber")


@query(
    "tags_to_columns",
    """SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_suppkey::varchar AS supplier, 'none' AS owner
       FROM lineitem""",
)
def tags_to_columns(spark: SparkSession, sf: str) -> DataFrame:
    columns = {"flag": ("flag", None), "supplier": ("supplier", "?"), "owner": ("owner", "none")}
    return H.tags_to_columns(tagged_lines(spark, sf), "tags", columns).drop("tags")


@query(
    "none_match_filter",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 40 OR l_discount > 0.08)",
)
def none_match_filter(spark: SparkSession, sf: str) -> DataFrame:
    associations = F.array(
        F.struct((F.col("l_quantity") > 40).alias("main")), F.struct((F.col("l_discount") > 0.08).alias("main"))
    )
    lines = table(spark, sf, "lineitem").withColumn("associations", associations)
    return lines.where(none_of(F.col("associations"), "main")).select("l_orderkey", "l_linenumber")


@query(
    "nested_ids",
    """SELECT l_orderkey, l_linenumber, len(ids) AS n_ids, array_to_string(ids, ',') AS snapshot_ids FROM (
         SELECT l_orderkey, l_linenumber,
                list_filter([CASE WHEN l_quantity > 25 THEN l_partkey END, l_suppkey], lambda x: x IS NOT NULL) AS ids
         FROM lineitem)""",
)
def nested_ids(spark: SparkSession, sf: str) -> DataFrame:
    devices = F.array(
        F.struct(F.when(F.col("l_quantity") > 25, F.col("l_partkey")).alias("snapshot_id")),
        F.struct(F.col("l_suppkey").alias("snapshot_id")),
    )
    ids = non_null_ids(devices, "snapshot_id")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.size(ids).cast("bigint").alias("n_ids"),
        F.array_join(ids.cast("array<string>"), ",").alias("snapshot_ids"),
    )


@query(
    "state_membership",
    """SELECT o_orderkey, state, state IN ('COMPLETED', 'FAILED', 'CANCELLED') AS is_terminal,
              state IN ('RUNNING', 'WAITING') AS is_ready,
              state IN ('STARTING', 'BOOTSTRAPPING', 'RUNNING', 'WAITING') AS is_active,
              state IN ('TERMINATED', 'TERMINATED_WITH_ERRORS') AS is_terminated
       FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'WAITING'
             ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'STARTING' ELSE 'TERMINATED' END END AS state FROM orders)""",
)
def state_membership(spark: SparkSession, sf: str) -> DataFrame:
    state = (
        F.when(F.col("o_orderstatus") == "F", "FAILED")
        .when(F.col("o_orderstatus") == "P", "WAITING")
        .otherwise(F.when(F.col("o_orderkey") % 2 == 0, "STARTING").otherwise("TERMINATED"))
    )
    steps = table(spark, sf, "orders").select("o_orderkey", state.alias("state"))
    return steps.select(
        "*",
        is_terminal_step(F.col("state")).alias("is_terminal"),
        is_ready_cluster(F.col("state")).alias("is_ready"),
        is_active_cluster(F.col("state")).alias("is_active"),
        is_terminated_cluster(F.col("state")).alias("is_terminated"),
    )


@query(
    "label_roles",
    """SELECT event_id, CASE WHEN k >= 50 AND k % 2 = 0 THEN event_type || ',worker' WHEN k >= 50 THEN event_type
                             WHEN k % 2 = 0 THEN 'worker' ELSE '<none>' END AS roles,
              CASE WHEN k % 3 = 0 THEN 'Ready' ELSE 'NotReady' END AS status
       FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::int AS k FROM events)""",
)
def label_roles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    prefix = "node-role.kubernetes.io/"
    own = F.when(k >= 50, F.concat(F.lit(prefix), F.col("event_type"))).otherwise(F.lit("kind"))
    worker = F.when(k % 2 == 0, F.lit(prefix + "worker")).otherwise(F.lit("zone"))
    conditions = F.array(
        F.struct(F.lit("Disk").alias("type"), F.lit("True").alias("status")),
        F.struct(F.lit("Ready").alias("type"), F.when(k % 3 == 0, "True").otherwise("False").alias("status")),
    )
    labels = F.create_map(own, F.lit(""), worker, F.lit(""))
    return table(spark, sf, "events").select(
        "event_id",
        F.array_join(roles(labels, prefix), ",").alias("roles"),
        node_ready(conditions).alias("status"),
    )


@query(
    "host_table_filter",
    "SELECT c_custkey, c_name FROM customer WHERE c_name IN (SELECT DISTINCT 'Customer#' || lpad((s_suppkey * 3)::varchar, 9, '0') FROM supplier)",
)
def host_table_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The wanted names as a table instead of a list."""
    key = F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")
    wanted = table(spark, sf, "supplier").select(F.concat(F.lit("Customer#"), key).alias("alias"))
    return H.pick_hosts(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", wanted)


@query(
    "default_group_exclusion",
    """SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 0 OR s_nationkey = 3""",
)
def default_group_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Groups without the default one of each network, which is wanted in network 3 only."""
    name = F.when(F.col("s_suppkey") % 10 == 0, "default").when(F.col("s_suppkey") % 10 == 1, None).otherwise("own")
    groups = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", name.alias("name"))
    others = R.without_default(groups.where(F.col("s_nationkey") != 3), "name")
    return others.unionByName(R.without_default(groups.where(F.col("s_nationkey") == 3), "name", include_default=True)).drop("name")
