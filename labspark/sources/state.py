"""Stored cluster state documents: explicit schema, lenient reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = "struct<publicIp string, privateIp string, alias string, availabilityZone string, instanceId string>"

# Fields of the stored set-up options, their types and what an absent one stands for.
INIT_DEFAULTS: dict[str, tuple[str, object]] = {
    "cassandraInstances": ("int", 3),
    "stressInstances": ("int", 0),
    "instanceType": ("string", "r3.2xlarge"),
    "stressInstanceType": ("string", "c7i.2xlarge"),
    "azs": ("array<string>", []),
    "ami": ("string", ""),
    "region": ("string", "us-west-2"),
    "name": ("string", "cluster"),
    "ebsType": ("string", "NONE"),
    "ebsSize": ("int", 256),
    "ebsIops": ("int", 3000),
    "ebsThroughput": ("int", 125),
    "ebsOptimized": ("boolean", False),
    "open": ("boolean", False),
    "controlInstances": ("int", 1),
    "controlInstanceType": ("string", "t3.xlarge"),
    "tags": ("map<string,string>", {}),
    "arch": ("string", "AMD64"),
    "sparkEnabled": ("boolean", False),
    "sparkMasterInstanceType": ("string", "m5.xlarge"),
    "sparkWorkerInstanceType": ("string", "m5.xlarge"),
    "sparkWorkerCount": ("int", 3),
    "opensearchEnabled": ("boolean", False),
    "opensearchInstanceType": ("string", "t3.small.search"),
    "opensearchInstanceCount": ("int", 1),
    "opensearchVersion": ("string", "2.11"),
    "opensearchEbsSize": ("int", 100),
}

STATE_SCHEMA = ", ".join(
    [
        "name string",
        "versions map<string,string>",
        "initConfig struct<" + ", ".join(f"{name}: {kind}" for name, (kind, _) in INIT_DEFAULTS.items()) + ">",
        "clusterId string",
        "createdAt timestamp",
        "lastAccessedAt timestamp",
        "infrastructureStatus string",
        f"hosts map<string, array<{HOST}>>",
        "vpcId string",
        "emrCluster struct<clusterId: string, clusterName: string, masterPublicDns: string, state: string>",
        "openSearchDomain struct<domainName: string, domainId: string, endpoint: string, "
        "dashboardsEndpoint: string, state: string>",
        "infrastructure struct<vpcId: string, subnetIds: array<string>, securityGroupId: string, "
        "internetGatewayId: string, routeTableId: string>",
        "s3Bucket string",
        "backupHashes map<string,string>",
    ]
)


def _default(kind: str, value: object) -> Column:
    if isinstance(value, list):
        return F.array().cast(kind)
    if isinstance(value, dict):
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.lit(value).cast(kind)


# Fields inside other parts of a document and what an absent one stands for.
NESTED_DEFAULTS = (
    ("emrCluster", "state", "STARTING"),
    ("openSearchDomain", "state", "Creating"),
    ("infrastructure", "subnetIds", []),
)


def _with_default(outer: str, inner: str, value: object) -> Column:
    """The part with the field filled; a document without the part keeps null there."""
    kind = "array<string>" if isinstance(value, list) else "string"
    filled = F.col(outer).withField(inner, F.coalesce(F.col(f"{outer}.{inner}"), _default(kind, value)))
    return F.when(F.col(outer).isNotNull(), filled)


def parse_state(df: DataFrame, body: str = "body") -> DataFrame:
    """State documents as typed columns.

    Unknown fields are dropped and absent ones get their defaults. A document without set-up options keeps null there.
    """
    state = df.select(*[c for c in df.columns if c != body], F.from_json(body, STATE_SCHEMA).alias("_state"))
    init = F.struct(
        *[
            F.coalesce(F.col(f"_state.initConfig.{name}"), _default(kind, value)).alias(name)
            for name, (kind, value) in INIT_DEFAULTS.items()
        ]
    )
    out = state.select(*[c for c in state.columns if c != "_state"], "_state.*", F.col("_state"))
    no_map = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    no_hosts = F.from_json(F.lit("{}"), f"map<string, array<{HOST}>>")
    return (
        out.withColumn("initConfig", F.when(F.col("_state.initConfig").isNotNull(), init))
        .withColumn("infrastructureStatus", F.coalesce("infrastructureStatus", F.lit("UNKNOWN")))
        .withColumn("hosts", F.coalesce("hosts", no_hosts))
        .withColumn("backupHashes", F.coalesce("backupHashes", no_map))
        .withColumns({outer: _with_default(outer, inner, value) for outer, inner, value in NESTED_DEFAULTS})
        .drop("_state")
    )


def state_hosts(states: DataFrame, *extra: Column) -> DataFrame:
    """One row per stored host: cluster, server type, the host's fields and ``extra`` columns of its document."""
    by_type = states.select(
        F.col("clusterId").alias("cluster_id"), *extra, F.explode("hosts").alias("server_type", "_hosts")
    )
    return by_type.select(*[c for c in by_type.columns if c != "_hosts"], F.inline("_hosts"))
