"""JSON documents as rows of paths and back, and deep merges of documents by their paths.

A path is the keys from the root, ``$``, joined by dots; a dot or percent sign within a key is written ``%2E`` or ``%25``. The
value is JSON text. Lists are values as a whole, as are empty objects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators.catalogue import overlay_paths
from labspark.session import scratch_path

LEVELS = 4


def _escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E"))


def _plain(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("%2E"), F.lit(".")), F.lit("%25"), F.lit("%"))


def _branch(value: Column) -> Column:
    """The value if it is an object with keys, else null."""
    return F.when(F.schema_of_variant(value).rlike("^OBJECT<.+>$"), value)


def _opened(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects replaced by a row for each of their keys; other rows stay."""
    inner = df.sparkSession.tvf.variant_explode_outer(F.col("_branch").outer())
    pairs = df.withColumn("_branch", _branch(F.col("_value"))).lateralJoin(inner)
    into = F.col("key").isNotNull()
    return pairs.select(
        *keys,
        F.when(into, F.concat_ws(".", "path", _escaped(F.col("key")))).otherwise(F.col("path")).alias("path"),
        F.when(into, F.col("value")).otherwise(F.col("_value")).alias("_value"),
    )


def flatten(df: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """One row per document and path: the document's ``keys``, ``path`` and ``value``.

    A null body, or one that is no JSON, has no rows. Four levels are opened in each pass over what is still an object, so
    documents may be nested to any depth; each pass is stored, and the deeper ones read deeper documents only.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(F.col(body)).alias("_value"))
    rows = rows.where(F.col("_value").isNotNull())
    done: DataFrame | None = None
    while True:
        for _ in range(LEVELS):
            rows = _opened(rows, keys)
        folder = scratch_path(spark, "paths")
        still = _branch(F.col("_value")).isNotNull()
        rows.select(*keys, "path", F.to_json("_value").alias("value"), still.alias("_open")).write.parquet(folder)
        stored = spark.read.parquet(folder)
        closed = stored.where(~F.col("_open")).drop("_open")
        done = closed if done is None else done.unionByName(closed)
        rest = stored.where("_open")
        if rest.isEmpty():
            return done
        rows = rest.select(*keys, "path", F.parse_json("value").alias("_value"))


def rebuild(df: DataFrame, keys: Sequence[str], path: str = "path", value: str = "value", body: str = "body") -> DataFrame:
    """The documents of the paths, the keys of each object in order of their text.

    A document's paths are sorted; each then closes the objects that the one before was in and opens its own, so a document
    takes one shuffle and time in proportion to its paths.
    """
    parts = F.split(F.col(path), "\\.")
    paths = F.array_sort(F.collect_list(F.struct(parts.alias("p"), F.col(value).alias("v"))))
    rows = df.groupBy(*keys).agg(paths.alias("_paths"))

    def quoted(part: Column) -> Column:
        """The key as JSON text: an array of it without its brackets."""
        listed = F.to_json(F.array(_plain(part)))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    def piece(item: Column, i: Column) -> Column:
        p = item["p"]
        before = F.when(i > 0, F.get("_paths", i - 1)["p"])
        common = F.when(i > 0, F.array_position(F.zip_with(p, before, lambda a, b: ~a.eqNullSafe(b)), True) - 1).otherwise(F.lit(1))
        common = common.cast("int")
        closing = F.when(i > 0, F.concat(F.repeat(F.lit("}"), F.size(before) - 1 - common), F.lit(","))).otherwise(
            F.when(F.size(p) > 1, "{").otherwise("")
        )
        names = F.transform(F.slice(p, common + 1, F.size(p) - common), quoted)
        opening = F.when(F.size(p) > 1, F.concat(F.array_join(names, ":{"), F.lit(":"))).otherwise("")
        return F.concat(closing, opening, item["v"])

    last = F.size(F.element_at("_paths", -1)["p"]) - 1
    text = F.concat(F.array_join(F.transform("_paths", piece), ""), F.repeat(F.lit("}"), last))
    return rows.select(*keys, text.alias(body))


def merge_documents(base: DataFrame, patch: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Patch documents over base documents of the same keys, object by object.

    A list or scalar of the patch, null too, replaces what the base has there. An empty object leaves an object as it is.
    Documents of one side only stay as they are; a body that is null or no JSON counts as absent. Keys are not null and name
    one document on each side.
    """
    below = flatten(base, keys, body)
    over = flatten(patch, keys, body)
    ups = F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda n: F.array_join(F.slice("_parts", 1, n), ".")))
    deep = below.select(*keys, F.split("path", "\\.").alias("_parts")).where(F.size("_parts") > 1)
    objects = deep.select(*keys, ups.alias("path"))
    empty = over.where(F.col("value") == "{}")
    kept = over.where(F.col("value") != "{}").unionByName(empty.join(objects, [*keys, "path"], "left_anti"))
    return rebuild(overlay_paths(below, kept, keys=keys), keys, body=body)
