"""Typed resources of a network: inventory, exclusions, overlaps and firewall rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.plans.numbering import PAGE, paged

# Texts for well-known ports.
PORT_TEXTS = {
    22: "SSH",
    80: "HTTP",
    443: "HTTPS",
    3306: "MySQL",
    5432: "PostgreSQL",
    6379: "Redis",
    7000: "Cassandra Inter-node",
    7001: "Cassandra Inter-node SSL",
    9042: "Cassandra CQL",
    9142: "Cassandra CQL SSL",
    9160: "Cassandra Thrift",
    10000: "Cassandra JMX",
}
ROUTE_TABLE = "route_table"
#: Subnets of one page of a network's list.
IDS_PER_PAGE = 10_000
RULE = ["from_port", "to_port", "protocol", "cidr"]


def inventory(tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Typed tables as one: resource type to (table, network column, id column)."""
    parts = [
        df.select(
            F.col(network).cast("string").alias("vpc_id"),
            F.lit(kind).alias("resource_type"),
            F.col(key).cast("string").alias("resource_id"),
        )
        for kind, (df, network, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def resource_counts(resources: DataFrame) -> DataFrame:
    """Resources per network and type; types without resources have no row."""
    return resources.groupBy("vpc_id", "resource_type").agg(F.count(F.lit(1)).alias("n_resources"))


def resource_summary(resources: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per network with a count per listed type; route tables alone do not make ``has_resources`` true."""
    return resources.groupBy("vpc_id").agg(
        *[F.count_if(F.col("resource_type") == kind).alias(f"n_{kind}") for kind in kinds],
        F.bool_or(F.col("resource_type") != ROUTE_TABLE).alias("has_resources"),
    )


def overlapping(df: DataFrame, keys: Sequence[str], ids: str, wanted: DataFrame | Sequence[object]) -> DataFrame:
    """Keys of the rows whose id list shares an id with ``wanted``; none when ``wanted`` is empty.

    A literal list is compared inside the row. A table is semi-joined, and the keys are made unique again.
    """
    if not isinstance(wanted, DataFrame):
        if not wanted:
            return df.where(F.lit(False)).select(*keys)
        return df.where(F.arrays_overlap(ids, F.array(*[F.lit(v) for v in wanted]))).select(*keys)
    name = wanted.columns[0]
    items = df.select(*keys, F.explode(F.array_distinct(ids)).alias(name))
    return items.join(wanted, name, "left_semi").select(*keys).distinct()


def flatten_rules(df: DataFrame, ranges: str = "ranges") -> DataFrame:
    """One row per address range of each permission, with the protocol shown and a description.

    The description is that of the first range, else the port's text.
    """
    first, last = F.col("from_port"), F.col("to_port")
    text = F.lit(None).cast("string")
    for port, name in PORT_TEXTS.items():
        text = F.when(first == port, F.lit(name)).otherwise(text)
    of_port = F.when(first.isNull() | last.isNull(), F.lit("All traffic")).when(first == last, text)
    described = df.select(
        "*",
        F.coalesce(F.get(F.col(ranges), F.lit(0))["description"], of_port).alias("description"),
        F.when(F.col("protocol") == "-1", "All").otherwise(F.upper("protocol")).alias("protocol_text"),
        F.explode(F.transform(F.col(ranges), lambda r: r["cidr"])).alias("cidr"),
    )
    return described.where(F.col("cidr").isNotNull()).drop(ranges)


def missing_rules(wanted: DataFrame, existing: DataFrame, columns: Sequence[str] = RULE) -> DataFrame:
    """Wanted rules that no existing rule equals on all columns; equal absent ports count as equal."""
    present = existing.select(*[F.col(c).alias(f"_have_{c}") for c in columns]).distinct()
    same = F.lit(True)
    for column in columns:
        same = same & F.col(column).eqNullSafe(F.col(f"_have_{column}"))
    return wanted.join(present, same, "left_anti")


def infrastructure(resources: DataFrame, page_length: int = IDS_PER_PAGE) -> DataFrame:
    """Per network its subnets in order, and the first security group and internet gateway of the whole network.

    The list comes in pages of ``page_length`` subnets, told apart by ``page``; every page has the same first group and
    gateway. A network without subnets has one page, an empty one.
    """

    def of(kind: str) -> Column:
        return F.when(F.col("resource_type") == kind, F.col("resource_id"))

    firsts = resources.groupBy("vpc_id").agg(
        F.min(of("security_group")).alias("security_group_id"),
        F.min(of("internet_gateway")).alias("internet_gateway_id"),
    )
    subnets = resources.where(F.col("resource_type") == "subnet").select(F.col("vpc_id").alias("_network"), "resource_id")
    pages = (
        paged(subnets, ["_network"], ["resource_id"], page_length)
        .groupBy("_network", PAGE)
        .agg(F.sort_array(F.collect_list("resource_id")).alias("subnet_ids"))
    )
    return firsts.join(pages, F.col("vpc_id").eqNullSafe(F.col("_network")), "left").select(
        "vpc_id",
        F.coalesce(PAGE, F.lit(0).cast("bigint")).alias(PAGE),
        F.coalesce("subnet_ids", F.array().cast("array<string>")).alias("subnet_ids"),
        "security_group_id",
        "internet_gateway_id",
    )


def without_default(df: DataFrame, name: str, include_default: bool = False, default: str = "default") -> DataFrame:
    """Leave out the row of the default group, unless asked for; rows without a name stay."""
    return df if include_default else df.where(~F.col(name).eqNullSafe(default))


def first_with_tag(df: DataFrame, name: str, prefix: str, tagged: Column) -> DataFrame:
    """The first name, in order, with the prefix and the tag condition."""
    return df.where(F.col(name).startswith(prefix) & tagged).orderBy(name).limit(1)
