"""File, catalogue, configuration and job operators over documents, pages, parts and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.functions.status import job_status_by_activity as status_by_activity
from labspark.functions.text import contains, wanted_file
from labspark.operators import catalogue as C
from labspark.operators import hashtree as H
from labspark.operators import jobs as J
from labspark.operators import manifest as M
from labspark.operators.metrics import newest
from labspark.operators.prefix import prefix_frequency
from labspark.session import scratch_path
from labspark.sources import files, tables
from labspark.workload.prefixes import FREQUENCIES, key_values
from labspark.workload.registry import query, table


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", M.content_hash(F.col("text")).alias("hash"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against stored hashes: some gone, some altered since, some never stored."""
    documents = table(spark, sf, "documents")
    present = F.when(F.col("doc_id") % 17 != 0, M.content_hash(F.col("text")))
    current = documents.select(F.col("doc_id").alias("target"), "source", present.alias("hash"))
    old = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit("x"))).otherwise(F.col("text"))
    stored = documents.where(F.col("doc_id") % 3 != 0)
    stored = stored.select(F.col("doc_id").alias("target"), M.content_hash(old).alias("hash"))
    return M.changed_since(current, stored)


CHANGES = """(SELECT doc_id AS target, source, CASE WHEN doc_id % 17 = 0 THEN 'absent'
    WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'skip' ELSE 'upload' END AS action,
    CASE WHEN doc_id % 17 <> 0 THEN sha256(text) END AS hash FROM documents)"""


@query("incremental_diff", f"SELECT target, hash, action FROM {CHANGES}")
def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes(spark, sf).select("target", "hash", "action")


@query(
    "backup_summary",
    f"""SELECT source, count(*) AS checked, count(*) FILTER (action = 'upload') AS uploaded,
               count(*) FILTER (action = 'skip') AS skipped FROM {CHANGES} GROUP BY 1""",
)
def backup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.backup_summary(changes(spark, sf), "source")


@query(
    "dir_totals",
    "SELECT source, count(*) AS n_files, sum(n_chars)::bigint AS n_bytes FROM documents GROUP BY 1",
)
def dir_totals(spark: SparkSession, sf: str) -> DataFrame:
    return M.directory_totals(table(spark, sf, "documents"), "source", "n_chars")


@query(
    "dir_digest",
    """SELECT lang, sha256(string_agg(bucket || digest, '' ORDER BY bucket)) AS digest, sum(n)::bigint AS n_files
       FROM (SELECT lang, bucket, sha256(string_agg(path || hash, '' ORDER BY path)) AS digest, count(*) AS n
             FROM (SELECT *, substr(sha256(path), 1, 3) AS bucket
                   FROM (SELECT lang, source || '/' || doc_id AS path, sha256(text) AS hash FROM documents))
             GROUP BY 1, 2) GROUP BY 1""",
)
def dir_digest(spark: SparkSession, sf: str) -> DataFrame:
    hashed = table(spark, sf, "documents").select(
        "lang",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        M.content_hash(F.col("text")).alias("hash"),
    )
    return M.directory_digest(hashed, "lang", "path")


@query(
    "path_include_exclude",
    r"""SELECT page_id, url FROM (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS name FROM pages)
        WHERE regexp_matches(name, '^([\s\S]*\.html|[0-9]*5[\s\S]*)$') AND NOT regexp_matches(name, '^[\s\S]*\?[\s\S]*$')
          AND (name LIKE '%.html' OR name LIKE '5%')""",
)
def path_include_exclude(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.where(wanted_file(F.col("url"), ["*.html", "5*"], ["*?*"])).select("page_id", "url")


@query(
    "file_manifest",
    """SELECT 'lang=' || coalesce(lang, 'none') AS folder, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint AS n_bytes
       FROM documents GROUP BY 1""",
)
def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stored as plain text by language, those of no language too; the listing gives the bytes of each folder."""
    folder = scratch_path(spark, "texts")
    none = [F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")]
    texts = table(spark, sf, "documents").select(*none)
    texts.hint("rebalance", "lang").write.partitionBy("lang").text(folder)
    listed = files.manifest(spark, folder, "part-*")
    top = F.substring_index("relative_path", "/", 1).alias("folder")
    return listed.groupBy(top).agg(F.sum("size").alias("n_bytes"))


@query("sink_truncate_load", FREQUENCIES)
def sink_truncate_load(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prefix-count")
    counts = prefix_frequency(key_values(spark, sf))
    tables.reload(counts, path)
    return tables.reload(counts, path)


@query(
    "table_defaults",
    """SELECT id, updated_at, coalesce(CASE WHEN id % 4 = 1 THEN DATE '2020-02-02' END, updated_at::date) AS updated_at_date
       FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-05-06 07:08:09' ELSE o_orderdate END
                    AS updated_at FROM orders)""",
)
def table_defaults(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderdate")).alias("updated_at"),
        F.when(F.col("o_orderkey") % 4 == 1, F.lit("2020-02-02").cast("date")).alias("updated_at_date"),
    )
    now = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    return tables.fill_defaults(rows, {"updated_at": now, "updated_at_date": F.to_date("updated_at")})


@query(
    "catalogue_union",
    """SELECT version, java, url, origin FROM (
         SELECT p_partkey AS version, p_brand AS java, NULL::varchar AS url, 0 AS origin FROM part WHERE p_partkey % 2 = 0
         UNION ALL SELECT p_partkey, p_brand, p_name, 1 FROM part WHERE p_partkey % 2 = 1)""",
)
def catalogue_union(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    main = part.where(F.col("p_partkey") % 2 == 0)
    extra = part.where(F.col("p_partkey") % 2 == 1)
    names = [F.col("p_partkey").alias("version"), F.col("p_brand").alias("java")]
    joined = C.join_catalogues(main.select(*names), extra.select(*names, F.col("p_name").alias("url")))
    return joined.select("version", "java", "url", "origin")


@query("duplicate_keys", "SELECT p_name AS version, count(*) AS n_rows FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_keys(table(spark, sf, "part").select(F.col("p_name").alias("version")), ["version"])


@query(
    "config_overlay",
    """SELECT coalesce(b.path, p.path) AS path, CASE WHEN p.path IS NOT NULL THEN p.value ELSE b.value END AS value
       FROM (SELECT 'part.' || p_partkey || '.name' AS path, p_name AS value FROM part WHERE p_partkey % 10 <> 9
             UNION ALL SELECT 'part.' || p_partkey || '.brand', p_brand FROM part WHERE p_partkey % 15 <> 0) b
       FULL JOIN (SELECT 'part.' || p_partkey || '.name' AS path, p_type AS value FROM part
                  WHERE p_partkey % 3 = 0 AND p_partkey % 15 <> 0
                  UNION ALL SELECT 'part.' || p_partkey, p_type FROM part WHERE p_partkey % 15 = 0) p ON p.path = b.path
       WHERE NOT (p.path IS NULL AND split_part(b.path, '.', 2)::bigint % 15 = 0)""",
)
def config_overlay(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    key = F.col("p_partkey")

    def leaf(rows: Column, name: str, value: str) -> DataFrame:
        path = F.concat(F.lit("part."), key.cast("string"), F.lit(name))
        return part.where(rows).select(path.alias("path"), F.col(value).alias("value"))

    base = leaf(key % 10 != 9, ".name", "p_name").unionByName(leaf(key % 15 != 0, ".brand", "p_brand"))
    patch = leaf((key % 3 == 0) & (key % 15 != 0), ".name", "p_type").unionByName(leaf(key % 15 == 0, "", "p_type"))
    return C.overlay_paths(base, patch)


@query(
    "name_contains",
    "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red') AND contains(lower(p_name), 'bolt')",
)
def name_contains(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    both = contains(name, "red") & contains(name, "BOLT", ignore_case=True)
    return table(spark, sf, "part").where(both).select("p_partkey", "p_name")


@query(
    "job_status",
    """SELECT name, CASE WHEN s >= c THEN 'Completed' WHEN f > 0 THEN 'Failed' WHEN a > 0 THEN 'Running' ELSE 'Pending' END
                AS status, s || '/' || c AS completed,
              date_diff('second', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS age_seconds
       FROM (SELECT o_orderkey AS name, o_orderdate, o_orderkey % 4 AS s, o_custkey % 3 AS f, o_orderkey % 2 AS a,
                    CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 5 END AS c FROM orders)""",
)
def job_status(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    jobs = orders.select(
        key.alias("name"),
        F.when(key % 4 != 0, key % 4).alias("succeeded"),
        (F.col("o_custkey") % 3).alias("failed"),
        (key % 2).alias("active"),
        F.when(key % 5 != 0, key % 5).alias("completions"),
        F.col("o_orderdate").alias("created"),
    )
    overview = J.job_overview(jobs, newest(orders, "o_orderdate"))
    return overview.select("name", "status", "completed", "age_seconds")


@query(
    "recent_jobs",
    """SELECT step_id, start_time FROM (SELECT o_orderkey AS step_id,
         CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS start_time FROM orders)
       ORDER BY start_time DESC NULLS LAST, step_id LIMIT 10""",
)
def recent_jobs(spark: SparkSession, sf: str) -> DataFrame:
    start = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate"))
    steps = table(spark, sf, "orders").select(F.col("o_orderkey").alias("step_id"), start.alias("start_time"))
    return J.most_recent(steps, 10)


@query(
    "pod_ready_restarts",
    """SELECT pod, len(list_filter(c, lambda i: (pod + i) % 3 <> 0)) || '/' || greatest(len(c), 1) AS ready,
              coalesce(list_sum(list_transform(c, lambda i: CASE WHEN i = 2 THEN 0 ELSE (cust + i) % 5 END)), 0)::bigint AS restarts
       FROM (SELECT o_orderkey AS pod, o_custkey AS cust, range(1, o_orderkey % 4 + 1) AS c FROM orders)""",
)
def pod_ready_restarts(spark: SparkSession, sf: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    numbers = F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint")), lambda i: i <= key % 4)
    containers = F.transform(
        numbers,
        lambda i: F.struct(
            ((key + i) % 3 != 0).alias("ready"), F.when(i != 2, (customer + i) % 5).alias("restart_count")
        ),
    )
    pods = table(spark, sf, "orders").select(key.alias("pod"), containers.alias("containers"))
    return J.pod_readiness(pods).select("pod", "ready", "restarts")


@query(
    "job_status_by_activity",
    """SELECT o_orderkey AS name, CASE WHEN o_orderkey % 2 > 0 THEN 'Running' WHEN o_orderkey % 4 > 0 THEN 'Completed'
                                       WHEN o_custkey % 3 > 0 THEN 'Failed' ELSE 'Unknown' END AS status FROM orders""",
)
def job_status_by_activity(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = status_by_activity(F.when(key % 4 != 0, key % 4), F.col("o_custkey") % 3, key % 2)
    return table(spark, sf, "orders").select(key.alias("name"), status.alias("status"))


@query(
    "pod_ready_floor",
    """SELECT o_orderkey AS pod, len(list_filter(range(1, o_orderkey % 4 + 1), lambda i: (o_orderkey + i) % 3 <> 0)) || '/'
              || greatest(o_orderkey % 4, o_custkey % 6, 1) AS ready FROM orders""",
)
def pod_ready_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Pods whose wanted number of containers is known before all of them report."""
    key = F.col("o_orderkey")
    numbers = F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint")), lambda i: i <= key % 4)
    containers = F.transform(
        numbers, lambda i: F.struct(((key + i) % 3 != 0).alias("ready"), F.lit(0).alias("restart_count"))
    )
    pods = table(spark, sf, "orders").select(key.alias("pod"), "o_custkey", containers.alias("containers"))
    return J.pod_readiness(pods, floor=(F.col("o_custkey") % 6).cast("int")).select("pod", "ready")


@query(
    "backup_all_targets",
    """SELECT count(*) AS checked, count(*) FILTER (hash IS NOT NULL AND hash IS DISTINCT FROM old) AS uploaded,
              count(*) FILTER (hash = old) AS skipped
       FROM (SELECT sha256(text) AS hash, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(text || '.') END AS old
             FROM documents
             UNION ALL SELECT NULL, NULL FROM benchmark)""",
)
def backup_all_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is a target, and so is every benchmark item, which no document belongs to: it counts as checked too.

    Of three documents one is stored as it is, one was stored with another text and one is new."""
    documents = table(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("target"), "doc_id", "text")
    items = table(spark, sf, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("target"))
    targets = documents.select("target").unionByName(items)
    current = documents.select("target", M.content_hash(F.col("text")).alias("hash"))
    changed = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    known = documents.where(F.col("doc_id") % 3 < 2).select("target", M.content_hash(changed).alias("hash"))
    return M.backup_summary(M.changed_since(M.all_targets(current, targets), known))


@query(
    "tree_diff",
    """SELECT source AS directory, 'doc/' || doc_id AS path,
              CASE WHEN doc_id % 31 = 7 THEN 'added' WHEN doc_id % 37 = 5 THEN 'removed' ELSE 'changed' END AS change,
              CASE WHEN doc_id % 31 <> 7 THEN sha256(text) END AS old_hash,
              CASE WHEN doc_id % 31 = 7 THEN sha256(text) WHEN doc_id % 37 <> 5 THEN sha256(text || 'x') END AS new_hash
       FROM documents WHERE doc_id % 31 = 7 OR doc_id % 37 = 5 OR doc_id % 29 = 3 AND text IS NOT NULL""",
)
def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two states of all documents, by source, as stored trees: some documents added, some gone, some altered between them."""
    key = F.col("doc_id")
    documents = table(spark, sf, "documents").select("source", "doc_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    added, gone = key % 31 == 7, (key % 37 == 5) & (key % 31 != 7)
    altered = F.when((key % 29 == 3) & ~added, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    old, new = scratch_path(spark, "old-tree"), scratch_path(spark, "new-tree")
    before = documents.where(~added).withColumn("hash", M.content_hash(F.col("text")))
    after = documents.where(~gone).withColumn("hash", M.content_hash(altered))
    H.write_tree(before, old, "source", "path")
    H.write_tree(after, new, "source", "path")
    return H.tree_diff(spark, old, new)
