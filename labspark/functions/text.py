"""Names, paths and messages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The terminal colour codes to strip, and the error mark.
ANSI_ESCAPE = "\\x1b\\[[0-9;]*[a-zA-Z]"
ERROR_MARK = "ERROR: "

EDGE_SPACE = "^[\\s\\p{Z}\\x1c-\\x1f]+|[\\s\\p{Z}\\x1c-\\x1f]+$"


def name_type(name: Column) -> Column:
    """The image type held in a dashed name: third part from the end, ``unknown`` for names of under four parts."""
    parts = F.split(name, "-")
    return F.when(F.size(parts) >= 4, F.try_element_at(parts, F.lit(-3))).otherwise(F.lit("unknown"))


def normalise_arch(arch: Column) -> Column:
    """One spelling for the 64-bit Intel architecture; others unchanged."""
    return F.when(arch == "x86_64", F.lit("amd64")).otherwise(arch)


def glob(name: Column, pattern: str) -> Column:
    """Wildcard match where only ``*`` is special."""
    like = "".join("%" if ch == "*" else "\\" + ch if ch in "%_\\" else ch for ch in pattern)
    return name.like(like)


def contains(name: Column, part: str, ignore_case: bool = False) -> Column:
    return F.lower(name).contains(part.lower()) if ignore_case else name.contains(part)


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def any_glob(name: Column, patterns: Sequence[str]) -> Column:
    """True when the whole name matches one of the globs."""
    bodies = ["[\\s\\S]*".join(re.escape(piece) for piece in p.split("*")) for p in patterns]
    return name.rlike("^(?:" + "|".join(bodies) + ")\\z")


def wanted_file(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Base name matches an include glob (or there are none) and no exclude glob."""
    name = base_name(path)
    keep = any_glob(name, include) if include else F.lit(True)
    return keep & ~any_glob(name, exclude) if exclude else keep


def clean_message(message: Column) -> Column:
    """Strip colour codes, join lines with a space, trim any kind of space, collapse white space."""
    bare = F.regexp_replace(message, ANSI_ESCAPE, "")
    line = F.regexp_replace(F.regexp_replace(bare, "[\\r\\n]+", " "), EDGE_SPACE, "")
    return F.regexp_replace(line, "\\s+", " ")


def event_message(event_type: Column, message: Column) -> Column:
    """The cleaned message, with the error mark in front for error events."""
    mark = F.when(event_type == "error", F.lit(ERROR_MARK)).otherwise(F.lit(""))
    return F.concat(mark, clean_message(message))
