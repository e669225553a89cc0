"""Image operators over ``orders``: an order is an image, named from its priority, status and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.functions.text import glob, name_type, normalise_arch
from labspark.operators import images as I
from labspark.workload.registry import query, table


def images(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws(
            "-",
            F.lit("lab"),
            F.get(F.split("o_orderpriority", "-"), F.lit(1)),
            F.col("o_orderstatus"),
            F.date_format("o_orderdate", "yyyyMMdd"),
        ).alias("name"),
        F.col("o_orderstatus").alias("architecture"),
        F.col("o_orderdate").alias("creation_date"),
    )
    return I.with_image_group(named)


IMAGES = """(SELECT o_orderkey AS id,
    'lab-' || split_part(o_orderpriority, '-', 2) || '-' || o_orderstatus || '-' || strftime(o_orderdate, '%Y%m%d') AS name,
    o_orderstatus AS architecture, o_orderdate AS creation_date,
    split_part(o_orderpriority, '-', 2) AS image_type,
    split_part(o_orderpriority, '-', 2) || '-' || o_orderstatus AS group_key
  FROM orders)"""

RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY creation_date DESC, id) AS rn FROM {IMAGES})"""


@query("keep_newest_n", f"SELECT id, name, image_type, group_key, creation_date FROM {RANKED} WHERE rn <= 5")
def keep_newest_n(spark: SparkSession, sf: str) -> DataFrame:
    kept = I.keep_newest(images(spark, sf), 5)
    return kept.select("id", "name", "image_type", "group_key", "creation_date").orderBy("group_key", "id")


@query("prune_beyond_n", f"SELECT id, group_key, creation_date, rn > 2 AS surplus FROM {RANKED}")
def prune_beyond_n(spark: SparkSession, sf: str) -> DataFrame:
    marked = I.mark_surplus(images(spark, sf), 2)
    return marked.select("id", "group_key", "creation_date", "surplus")


@query(
    "newest_per_group",
    f"SELECT group_key, id, creation_date FROM {RANKED} WHERE rn = 1",
)
def newest_per_group(spark: SparkSession, sf: str) -> DataFrame:
    newest = I.newest_per_group(images(spark, sf), ["group_key"], "creation_date", "id")
    return newest.select("group_key", "id", "creation_date")


@query(
    "removed_dependents",
    f"""SELECT l_orderkey AS id, l_linenumber AS child_no, l_partkey AS snapshot_id
        FROM lineitem WHERE l_orderkey IN (SELECT id FROM {RANKED} WHERE rn > 100)""",
)
def removed_dependents(spark: SparkSession, sf: str) -> DataFrame:
    removed = I.mark_surplus(images(spark, sf), 100).where("surplus")
    children = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("child_no"), F.col("l_partkey").alias("snapshot_id")
    )
    return I.dependents_in_table(removed, "id", children, "id")


REQUESTS = [("lab-URGENT-*", "P"), ("lab-LOW-F-1998*", "F"), ("lab-HIGH-O-*", "F"), ("absent-*", "O"), ("*-19950101", "O")]


def _request_sql(i: int) -> str:
    pattern, arch = REQUESTS[i]
    like = pattern.replace("*", "%")
    return f"""SELECT '{pattern}' AS pattern, '{arch}' AS architecture, n_named, n_fitting, picked,
        CASE WHEN n_named = 0 THEN 'none' WHEN n_fitting = 0 THEN 'wrong_architecture'
             WHEN n_fitting > 1 THEN 'several' ELSE 'one' END AS status
      FROM (SELECT count(*) FILTER (name LIKE '{like}') AS n_named,
                   count(*) FILTER (name LIKE '{like}' AND architecture = '{arch}') AS n_fitting,
                   (SELECT id FROM {IMAGES} WHERE name LIKE '{like}' AND architecture = '{arch}'
                    ORDER BY creation_date DESC, id LIMIT 1) AS picked
            FROM {IMAGES})"""


@query("candidate_validation", " UNION ALL ".join(_request_sql(i) for i in range(len(REQUESTS))))
def candidate_validation(spark: SparkSession, sf: str) -> DataFrame:
    return I.check_candidates(images(spark, sf), REQUESTS)


@query(
    "type_filter_ci",
    "SELECT p_partkey, p_type FROM part WHERE lower(p_type) = 'economy'",
)
def type_filter_ci(spark: SparkSession, sf: str) -> DataFrame:
    return I.of_type(table(spark, sf, "part"), "Economy", "p_type").select("p_partkey", "p_type")


@query("name_glob", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0%7'")
def name_glob(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    return customers.where(glob(F.col("c_name"), "Customer#0*7")).select("c_custkey", "c_name")


@query(
    "name_type",
    """SELECT p_partkey,
         CASE WHEN len(string_split(name, '-')) >= 4 THEN string_split(name, '-')[-3] ELSE 'unknown' END AS image_type
       FROM (SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '-amd64-2024' ELSE '' END AS name
             FROM part)""",
)
def image_type(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.when(F.col("p_partkey") % 3 == 0, "-amd64-2024").otherwise("")
    name = F.concat(F.translate("p_name", " ", "-"), ending)
    return table(spark, sf, "part").select("p_partkey", name_type(name).alias("image_type"))


@query(
    "arch_normalise",
    """SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 'amd64' WHEN 'SMALL' THEN 'arm64' ELSE p_type END AS architecture
       FROM part""",
)
def arch_normalise(spark: SparkSession, sf: str) -> DataFrame:
    raw = (
        F.when(F.col("p_type") == "LARGE", "x86_64").when(F.col("p_type") == "SMALL", "arm64").otherwise(F.col("p_type"))
    )
    return table(spark, sf, "part").select("p_partkey", normalise_arch(raw).alias("architecture"))
