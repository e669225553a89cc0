"""Label maps and tag lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_labels(left: Column, right: Column) -> Column:
    """Both label maps in one; a key in both takes its value from ``right``."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def tags_to_map(tags: Column, key: str = "key", value: str = "value") -> Column:
    """A tag list as a map; when a key is repeated the last tag wins."""
    keys = F.transform(tags, lambda tag: tag[key])
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    last_wins = F.aggregate(
        tags,
        empty,
        lambda done, tag: F.map_concat(
            F.map_filter(done, lambda k, _: k != tag[key]), F.create_map(tag[key], tag[value])
        ),
    )
    values = F.transform(tags, lambda tag: tag[value])
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(unique, F.map_from_arrays(keys, values)).when(tags.isNotNull(), last_wins)


def tag_value(tags: Column, name: str, key: str = "key", value: str = "value") -> Column:
    """The value of the last tag with this key, null without one."""
    return F.try_element_at(F.filter(tags, lambda tag: tag[key] == name), F.lit(-1))[value]


def has_any_tag(tags: Column, wanted: Iterable[tuple[str, str]]) -> Column:
    """True when the list holds at least one of the wanted ``(key, value)`` pairs."""
    terms = list(wanted)

    def matches(tag: Column) -> Column:
        hit = F.lit(False)
        for key, value in terms:
            hit = hit | ((tag["key"] == key) & (tag["value"] == value))
        return hit

    return F.coalesce(F.exists(tags, matches), F.lit(False))


def none_of(items: Column, field: str) -> Column:
    """True when no struct of the list has a true ``field``; an absent list has none."""
    return ~F.coalesce(F.exists(items, lambda item: F.coalesce(item[field], F.lit(False))), F.lit(False))


def non_null_ids(items: Column, field: str) -> Column:
    """The non-null values of ``field`` over a list of structs, in list order."""
    return F.filter(F.transform(items, lambda item: item[field]), lambda value: value.isNotNull())


def roles(labels: Column, prefix: str = "node-role.kubernetes.io/", none: str = "<none>") -> Column:
    """Role names held in label keys, or ``[none]`` when there are none."""
    names = F.transform(
        F.filter(F.map_keys(labels), lambda key: key.startswith(prefix)),
        lambda key: F.substring(key, F.lit(len(prefix) + 1), F.length(key)),
    )
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, names).otherwise(F.array(F.lit(none)))


def node_ready(conditions: Column) -> Column:
    """``Ready`` when any condition is Ready with status True, else ``NotReady``."""
    ready = F.exists(conditions, lambda c: (c["type"] == "Ready") & (c["status"] == "True"))
    return F.when(F.coalesce(ready, F.lit(False)), F.lit("Ready")).otherwise(F.lit("NotReady"))
