"""License notices in texts: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

Everything is DataFrame functions. For each template length the shingles of a document lie in overlapping windows of that
length. A template at any place shares at least 7/9 of a union with some window (a window is at most an eighth of its
length off), so the two agree in a minimum with that chance and in one of ``BANDS`` bands of ``ROWS`` minima with a chance of
over 1 - 1e-6. Two minima can only agree if the window holds the shingle that is the template's minimum. Windows without
any such shingle are therefore passed over without forming their minima, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm.common import text_of

SHINGLE_WORDS = 5
BANDS = 16
ROWS = 2
CONTAINED = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"

# Names of licenses and words of their usual notices or titles. A template that names a family or version is so
# short that without the shingles that hold the name or version less than ``CONTAINED`` of it is left.
FSF = "as published by the Free Software Foundation"
TEMPLATES = (
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("agpl-3.0-header", f"terms of the GNU Affero General Public License {FSF}, either version 3 of the License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0-header",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        ' on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("apache-2.0-title", "Apache License Version 2.0, January 2004"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met",
    ),
    ("cc-by-3.0", "under a Creative Commons Attribution 3.0 Unported License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0-short", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0-notice", "under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa-4.0-notice", "under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-sa-3.0", "under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0-notice", "under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("epl-2.0", "terms of the Eclipse Public License 2.0"),
    ("gpl-2.0", "under the GNU General Public License, version 2"),
    ("gpl-2.0-header", f"terms of the GNU General Public License {FSF}; either version 2 of the License"),
    ("gpl-2.0-only-header", f"terms of the GNU General Public License version 2 {FSF}"),
    ("gpl-2.0-title", "GNU General Public License Version 2, June 1991"),
    ("gpl-3.0", "under the GNU General Public License, version 3"),
    ("gpl-3.0-header", f"terms of the GNU General Public License {FSF}, either version 3 of the License"),
    ("gpl-3.0-title", "GNU General Public License Version 3, 29 June"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("lgpl-2.0-header", f"terms of the GNU Library General Public License {FSF}; either version 2 of the License"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-2.1-header", f"terms of the GNU Lesser General Public License {FSF}; either version 2.1 of the License"),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3"),
    ("lgpl-3.0-header", f"terms of the GNU Lesser General Public License {FSF}; either version 3 of the License"),
    ("mit", "Released under the MIT License"),
    (
        "mit-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("mpl-2.0", "of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0-title", "Mozilla Public License, version 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def shingles(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles of a text in order: words are lower-case letters and digits; a short text is one shingle."""
    plain = F.regexp_replace(F.lower(text), f"^{NOT_WORD}|{NOT_WORD}$", "")
    parts = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, NOT_WORD))
    # The words go through a transform of one element, so that they are split once and not for each shingle.
    of_words = F.transform(
        F.array(parts),
        lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]),
        ),
    )
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.element_at(of_words, 1))


def minima(window: Column) -> Column:
    """For each hash function the shingle of a window that it makes smallest."""
    numbers = F.array(*[F.lit(i) for i in range(BANDS * ROWS)])
    least = lambda s: F.array_min(F.transform(window, lambda h: F.struct(F.xxhash64(h, s).alias("x"), h.alias("h"))))["h"]
    return F.transform(numbers, least)


def bands(signature: Column) -> Column:
    numbers = F.array(*[F.lit(i) for i in range(BANDS)])

    def of(held: Column) -> Column:
        return F.transform(numbers, lambda b: F.xxhash64(b, *[F.get(held, b * ROWS + r) for r in range(ROWS)]))

    # A transform of one element again, so that the signature is formed once and not for each band.
    return F.element_at(F.transform(F.array(signature), of), 1)


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """``template``, its distinct shingles, its length in shingles and its signature."""
    table = spark.createDataFrame(list(templates), "template string, text string")
    parsed = table.select("template", shingles(F.col("text")).alias("all"))
    return parsed.select(
        "template", F.array_distinct("all").alias("of"), F.size("all").alias("length"), minima(F.col("all")).alias("signature")
    )


def license_matches(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    contained: float = CONTAINED,
) -> DataFrame:
    """Templates found in each row: ``id``, ``template``, ``containment``, ``matched``, ``shingles`` and ``first_word``.

    ``containment`` is the share of the template's ``shingles`` distinct shingles that the whole text holds, ``matched`` of
    them; it is at least ``contained``. ``first_word`` begins the first window that the template was retrieved by. Null,
    empty and very short texts give no row, unless a template is as short. Repeated rows give a row each. An empty table
    gives no rows. Templates are a list that the caller holds, so their table may be broadcast.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    rows = table.collect()
    signs = sorted({h for r in rows for h in r["signature"]})
    lengths = sorted({r["length"] for r in rows})

    text = docs.select(
        F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), shingles(text_of(text_column)).alias("all")
    )
    hits = F.filter(F.transform("all", lambda h, i: F.when(h.isin(signs), i)), lambda i: i.isNotNull())
    near = text.withColumn("hits", hits).where(F.size("hits") > 0)

    def windows(length: int) -> Column:
        step = max(1, length // 4)

        def starts(i: Column) -> Column:
            low = F.ceil(F.greatest(i - (length - 1), F.lit(0)) / step).cast("int") * step
            high = F.floor(i / step).cast("int") * step
            return F.when(low <= high, F.sequence(low, high, F.lit(step))).otherwise(F.array().cast("array<int>"))

        return F.transform(
            F.array_distinct(F.flatten(F.transform("hits", starts))),
            lambda s: F.struct(F.lit(length).alias("length"), s.alias("start"), F.slice("all", s + 1, length).alias("of")),
        )

    # Shingles of each template in the whole text: what verifies, counted here so that texts are not carried on. The text is
    # first cut down, once, to the shingles that any template has.
    def array_of(values: list[int]) -> Column:
        return F.array(*[F.lit(h) for h in values])

    def count(held: Column) -> Column:
        sizes = [(r["template"], F.size(F.array_intersect(array_of(r["of"]), held))) for r in rows]
        return F.map_from_entries(F.array(*[F.struct(F.lit(t).alias("key"), n.alias("value")) for t, n in sizes]))

    of_any = array_of(sorted({h for r in rows for h in r["of"]}))
    counts = F.element_at(F.transform(F.array(F.array_intersect(of_any, F.col("all"))), count), 1)
    each = near.select(
        "id", "row", counts.alias("counts"), F.explode(F.concat(*[windows(n) for n in lengths])).alias("w")
    )
    signed = each.select("id", "row", "counts", "w.length", "w.start", F.explode(bands(minima(F.col("w.of")))).alias("band"))
    held = table.select("template", "length", F.size("of").alias("shingles"), F.explode(bands(F.col("signature"))).alias("band"))
    found = signed.join(F.broadcast(held), ["length", "band"]).withColumn("matched", F.col("counts")[F.col("template")])
    verified = found.where(F.col("matched") >= F.col("shingles") * contained)
    return (
        verified.groupBy("row", "id", "template", "matched", "shingles")
        .agg(F.min("start").alias("first_word"))
        .select("id", "template", (F.col("matched") / F.col("shingles")).alias("containment"), "matched", "shingles", "first_word")
    )
