"""The operators of this folder applied to the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm import pii, secrets
from labspark.llm.common import TOKENIZER, documents, importable, labels
from labspark.llm.conversations import repaired_conversations
from labspark.llm.decontamination import LOWER, UPPER, WORD, benchmark_hits
from labspark.llm.exact_dedup import exact_classes
from labspark.llm.hard_negatives import hard_negatives
from labspark.llm.licenses import TEMPLATES, license_matches
from labspark.llm.mixing import mix_counts
from labspark.llm.packing import pack_documents
from labspark.llm.quality import THRESHOLD, fit, held_out, score
from labspark.llm.simhash import near_duplicates
from labspark.llm.token_files import read_token_checksums, write_token_files
from labspark.llm.topk import divisible, top_k
from labspark.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = importable(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op3_exact_dedup",
    """
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM (
        SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
        FROM documents
    )
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = exact_classes(documents(spark, sf_dir), keep="largest")
    return classes.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, TOKENIZER)
    return read_token_checksums(spark, folder)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), TOKENIZER).withColumnRenamed("id", "doc_id")


@query("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir)
    model = fit(docs, known.where(~held_out("doc_id")))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def span_line(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def span_digest(found: DataFrame, kinds: tuple[str, ...], counted: int) -> DataFrame:
    """Counts of the base spans of the first ``counted`` kinds, their digest, and all spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kinds[kind]}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(i) for i in range(counted)],
        F.sha2(span_line(F.col("base"), kinds), 256).alias("base_sha256"),
        span_line(F.array_sort(F.concat("base", "added")), kinds).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


@query("op1_personal_data")
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(pii.personal_data(documents(spark, sf_dir)), pii.KINDS, 4)


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secrets.secrets(documents(spark, sf_dir)), secrets.KINDS, 3)


LICENSES_SQL = """
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents
),
shingles AS (
    SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM words WHERE len(w) > 0
),
names(template, text) AS (VALUES {templates}),
template_words AS (
    SELECT template, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM names
),
wanted AS (
    SELECT template, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS t
    FROM template_words
),
counted AS (
    SELECT doc_id, template, len(list_intersect(t, s)) AS matched, len(t) AS shingles FROM shingles, wanted
)
SELECT doc_id, template, matched / shingles AS containment, CAST(matched AS INTEGER) AS matched, CAST(shingles AS INTEGER) AS shingles
FROM counted WHERE matched >= shingles * 0.8
""".replace("{templates}", ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES))


@query("op2_license_scan", LICENSES_SQL)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("first_word")


@query(
    "op7_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= 10
    """,
)
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, divisible(vectors, "vec_id", 100)).withColumnRenamed("id", "vec_id")


DECONTAMINATION_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w
    FROM documents
),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w
    FROM benchmark
),
windows AS (
    SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS run
    FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM items WHERE len(w) > 0)
),
runs AS (
    SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS run
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows))
),
hits AS (SELECT r, n, p, item FROM runs JOIN windows USING (n, run)),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM hits) GROUP BY r),
named AS (
    SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""".replace("{upper}", UPPER).replace("{lower}", LOWER).replace("{word}", WORD)


@query("op12_decontamination", DECONTAMINATION_SQL)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
               CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id
        WHERE a.vec_id % 100 = 0
    ),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score
        FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scored WHERE same)
        WHERE n <= 5
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM (
        SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    )
    WHERE rank <= 10
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    other = (F.col("label").cast("bigint") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, other).otherwise(F.col("label").cast("bigint"))
    vectors = vectors.withColumn("label", label)
    return hard_negatives(vectors, divisible(vectors, "vec_id", 100))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults: rows left out, emptied, cut off, repeated or given to the user, by a checksum."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    return rows.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    )


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    reports = repaired_conversations(damaged(conversations)).reports
    every = conversations.select("conv_id").distinct()
    joined = every.join(reports, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.when(F.col("audit").isNull(), F.lit(0).cast("bigint"))).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
