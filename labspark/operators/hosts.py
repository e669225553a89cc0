"""Instances and hosts: discovery, live state, capacity, placement, reconciliation and state documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.labels import tag_value, tags_to_map
from labspark.plans.numbering import PAGE, paged
from labspark.plans.topn import first_n

# Server types in lookup order, with the tag text of each.
SERVER_TYPES = {"Cassandra": "db", "Stress": "app", "Control": "control"}
DEFAULT_CLUSTER_NAME = "recovered-cluster"

#: Hosts of one page of a list, so that a row stays small however large its cluster is.
HOSTS_PER_PAGE = 10_000


def flatten_reservations(df: DataFrame, instances: str = "instances") -> DataFrame:
    """One row per instance of nested reservations, its tag list as a map ``tag_map``."""
    flat = df.select(*[c for c in df.columns if c != instances], F.inline(instances))
    return flat.withColumn("tag_map", tags_to_map(F.col("tags"))).drop("tags")


def tags_to_columns(df: DataFrame, tags: str, wanted: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Chosen tags as columns: column name to (tag key, default)."""
    return df.select(
        "*",
        *[
            F.coalesce(tag_value(F.col(tags), key), F.lit(default)).alias(column)
            for column, (key, default) in wanted.items()
        ],
    )


def check_required(df: DataFrame, required: Sequence[str], server_type: str, known: DataFrame) -> DataFrame:
    """Add ``verdict``: ``missing_tags``, ``unknown_type`` or ``accepted``.

    ``known`` is a table with one row per type in the column named as ``server_type``; further columns are attached.
    """
    marked = known.withColumn("_known", F.lit(True))
    missing = F.lit(False)
    for column in required:
        missing = missing | F.col(column).isNull()
    verdict = (
        F.when(missing, "missing_tags").when(F.col("_known").isNull(), "unknown_type").otherwise("accepted")
    )
    return df.join(marked, server_type, "left").withColumn("verdict", verdict).drop("_known")


def live_state(stored: DataFrame, live: DataFrame, key: str, state: str = "state") -> DataFrame:
    """Stored hosts with their live state in capitals, ``UNKNOWN`` where the live side has no row."""
    joined = stored.join(live.select(key, F.col(state).alias("_live")), key, "left")
    return joined.select(*stored.columns, F.upper(F.coalesce("_live", F.lit("UNKNOWN"))).alias("live_state"))


def refresh(stored: DataFrame, live: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Take the live value of each column where there is one, else keep the stored one; ``drifted`` marks changes."""
    fresh = live.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    taken = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    drifted = F.lit(False)
    for c in columns:
        drifted = drifted | ~taken[c].eqNullSafe(F.col(c))
    return stored.join(fresh, key, "left").select(
        *[taken[c].alias(c) if c in taken else F.col(c) for c in stored.columns], drifted.alias("drifted")
    )


def capacity_gap(wanted: DataFrame, existing: DataFrame, keys: Sequence[str], configured: str) -> DataFrame:
    """Wanted less existing per key, and what follows: ``create``, ``enough`` or ``none``."""
    counts = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_found"))
    found = F.coalesce(F.col("_found"), F.lit(0))
    joined = wanted.join(counts, list(keys), "left")
    needed = F.col(configured).cast("bigint") - F.col("existing_count")
    step = (
        F.when(F.col("needed_count") > 0, "create")
        .when((F.col(configured) > 0) & (F.col("existing_count") > 0), "enough")
        .otherwise("none")
    )
    return (
        joined.select(*wanted.columns, found.alias("existing_count"))
        .withColumn("needed_count", needed)
        .withColumn("step", step)
    )


def place_missing(gaps: DataFrame, server_type: str, configured: str, subnets: Column) -> DataFrame:
    """One row per missing instance: index from the existing count on, alias, and subnets taken in turn."""
    indexes = F.sequence(F.col("existing_count").cast("bigint"), F.col(configured).cast("bigint") - 1)
    rows = gaps.where(F.col("needed_count") > 0).withColumn("host_index", F.explode(indexes))
    turn = F.pmod(F.col("host_index"), F.size(subnets)).cast("int")
    return rows.select(
        "*",
        F.concat(F.col(server_type).cast("string"), F.col("host_index").cast("string")).alias("alias"),
        F.get(subnets, turn).alias("subnet"),
    )


def host_differences(stored: DataFrame, current: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """How often each row occurs in either snapshot. Both sides are counted in one pass, without a join."""
    keys = [F.col(c) for c in [cluster, *columns]]
    both = stored.select(*keys, F.lit(1).alias("_stored"), F.lit(0).alias("_current")).unionByName(
        current.select(*keys, F.lit(0).alias("_stored"), F.lit(1).alias("_current"))
    )
    return both.groupBy(cluster, *columns).agg(
        F.sum("_stored").alias("n_stored"), F.sum("_current").alias("n_current")
    )


def reconcile(stored: DataFrame, current: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """One verdict per cluster: do both snapshots hold the same rows, as multisets of ``columns``?"""
    counts = host_differences(stored, current, cluster, columns)
    different = F.col("n_stored") != F.col("n_current")
    return counts.groupBy(cluster).agg(
        F.sum("n_stored").alias("n_stored"),
        F.sum("n_current").alias("n_current"),
        F.count_if(different).alias("n_different"),
        (~F.bool_or(different)).alias("hosts_match"),
    )


def readiness(df: DataFrame, cluster: str, state: str = "state", public_ip: str = "public_ip") -> DataFrame:
    """Per cluster: are all instances running with a public address, and how many are."""
    running = F.col(state).eqNullSafe("running")
    addressed = F.coalesce(F.col(public_ip) != "", F.lit(False))
    return df.groupBy(cluster).agg(
        F.bool_and(running & addressed).alias("all_ready"),
        F.count_if(running).alias("n_running"),
        F.count_if(addressed).alias("n_addressed"),
        F.count(F.lit(1)).alias("n_instances"),
    )


def split_names(text: str) -> list[str]:
    """Names of a comma-separated list, blank ones left out."""
    return [name for name in text.split(",") if name.strip()]


def pick_hosts(df: DataFrame, alias: str, names: str | DataFrame) -> DataFrame:
    """Hosts named in a comma-separated list, or in a table with an ``alias`` column; an empty list keeps all."""
    if isinstance(names, DataFrame):
        return df.join(names.select(F.col("alias").alias(alias)), alias, "left_semi")
    wanted = split_names(names)
    return df.where(F.col(alias).isin(wanted)) if wanted else df


def resolve_alias(df: DataFrame, alias: str, server_type: str, tie: str) -> DataFrame:
    """One host per alias, taken from the first server type in lookup order that has it."""
    rank = F.lit(len(SERVER_TYPES))
    for i, kind in enumerate(SERVER_TYPES.values()):
        rank = F.when(F.col(server_type) == kind, F.lit(i)).otherwise(rank)
    return first_n(df, [alias], [rank, F.asc(tie)], 1)


def contact_points(
    df: DataFrame, cluster: str, alias: str, address: str, page_length: int = HOSTS_PER_PAGE
) -> DataFrame:
    """Addresses of each cluster in alias order, comma-separated, in pages of ``page_length`` hosts.

    Pages follow the order, so joining a cluster's texts by ``page`` gives the whole list whatever the length of a page.
    """
    return paged(df, [cluster], [alias, address], page_length).groupBy(cluster, PAGE).agg(
        F.expr(f"listagg(`{address}`, ',') WITHIN GROUP (ORDER BY position)").alias("contact_points"),
        F.count(F.lit(1)).alias("n_hosts"),
    )


def state_documents(
    hosts: DataFrame,
    cluster: str,
    server_type: str,
    fields: Sequence[str],
    alias: str = "alias",
    page_length: int = HOSTS_PER_PAGE,
) -> DataFrame:
    """Hosts as a nested row per cluster: a map of server type to hosts in alias order, in pages of ``page_length`` hosts.

    Pages follow server type and alias, so appending a cluster's lists by ``page`` gives the whole map.
    """
    host = F.struct(alias, *[f for f in fields if f != alias])
    lists = (
        paged(hosts, [cluster], [server_type, alias, *[f for f in fields if f != alias]], page_length)
        .groupBy(cluster, PAGE, server_type)
        .agg(F.sort_array(F.collect_list(host)).alias("_hosts"))
    )
    by_type = F.sort_array(F.collect_list(F.struct(F.col(server_type).alias("key"), F.col("_hosts").alias("value"))))
    return lists.groupBy(cluster, PAGE).agg(F.map_from_entries(by_type).alias("hosts"))


def rebuild_state(networks: DataFrame, documents: DataFrame, tags: str = "tags") -> DataFrame:
    """State per network from its tags: a network without ClusterId fails the job, a missing name gets the default."""
    tagged = tags_to_columns(networks, tags, {"cluster_id": ("ClusterId", None), "name": ("Name", DEFAULT_CLUSTER_NAME)})
    checked = tagged.withColumn(
        "cluster_id",
        F.when(F.col("cluster_id").isNotNull(), F.col("cluster_id")).otherwise(
            F.raise_error(F.concat(F.lit("no ClusterId tag on "), F.col("vpc_id")))
        ),
    )
    return checked.join(documents, "cluster_id", "left").withColumn("infrastructure_status", F.lit("UP"))
