"""Attributes under keys that nobody knows beforehand: JSON text as variants, searched and listed by key.

A variant keeps any JSON value. Stored as Parquet, Spark gives the keys that many rows share columns of their own, so a search
on such a key reads those columns and skips row groups; other keys are found in the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators.logs import OPERATORS

TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def parse(df: DataFrame, body: str = "body", parsed: str = "attributes") -> DataFrame:
    """Add the body as a variant. A body that is no JSON, or repeats a key in one object, is kept: its variant is null and
    ``malformed`` true. A null body is not malformed.
    """
    found = F.try_parse_json(F.col(body))
    return df.withColumn(parsed, found).withColumn("malformed", F.col(body).isNotNull() & F.col(parsed).isNull())


def variant_path(keys: Sequence[str | int]) -> str:
    """The path to a nested value, through object keys and list places from 0."""
    path = "$"
    for key in keys:
        if isinstance(key, int):
            path += f"[{key}]"
        elif '"' not in key:
            path += f'["{key}"]'
        elif "'" not in key:
            path += f"['{key}']"
        else:
            raise ValueError(f"a path cannot name a key with both kinds of quotes: {key}")
    return path


def attribute(parsed: str, keys: Sequence[str | int], kind: str = "string") -> Column:
    """The value under the keys as this type; null where it is absent or does not convert."""
    return F.try_variant_get(F.col(parsed), variant_path(keys), kind)


def search(
    df: DataFrame, terms: Sequence[tuple[Sequence[str | int], str, object]], parsed: str = "attributes"
) -> DataFrame:
    """Rows that meet every (keys, operator, value) term, compared as the type of the value.

    Rows without the attribute meet no term, ``!=`` and ``!~`` neither.
    """
    for keys, operator, value in terms:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator}")
        literal = value if operator in ("=~", "!~") else F.lit(value)
        df = df.where(OPERATORS[operator](attribute(parsed, keys, TYPES[type(value)]), literal))
    return df


def kind_of(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null``."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT<"), "object")
        .when(schema.startswith("ARRAY<"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.isNotNull(), "number")
    )


def listed(df: DataFrame, keep: Sequence[str], parsed: str = "attributes") -> DataFrame:
    """One row per attribute of the top level: ``key``, ``kind`` and a scalar's ``value`` as Spark's cast to text gives it.

    Rows whose variant is null, no object, or an empty one stay as one row with a null key.
    """
    is_object = kind_of(F.col(parsed)) == "object"
    rows = df.select(*keep, F.when(is_object, F.col(parsed)).alias("_object"))
    pairs = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_object").outer()))
    kind = kind_of(F.col("value"))
    scalar = F.when(~kind.isin("object", "array"), F.try_variant_get("value", "$", "string"))
    return pairs.select(*keep, "key", kind.alias("kind"), scalar.alias("value"))


def key_profile(df: DataFrame, parsed: str = "attributes") -> DataFrame:
    """The keys of the top level with their kinds and the rows that have them."""
    found = listed(df, [], parsed).where(F.col("key").isNotNull())
    return found.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
