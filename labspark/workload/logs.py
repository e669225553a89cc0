"""Log operators over events, conversations and documents."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.functions.text import event_message
from labspark.operators import attributes as A
from labspark.operators import logs as L
from labspark.operators import paths as P
from labspark.operators.metrics import relative_range
from labspark.session import scratch_path
from labspark.sources import files, skipping, tables
from labspark.workload.registry import query, table

BODY = T.StructType([T.StructField("k", T.IntegerType())])


def log_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines. Every seventh body is cut short, so that it is no JSON any more."""
    level = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "signup", "Warning")
    body = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    records = table(spark, sf, "events").select(
        "event_id", "ts", body.alias("body"), level.otherwise("Information").alias("level"), "user_id"
    )
    return L.enrich(
        records,
        {"database": "clickhouse", "component": F.when(F.col("user_id") % 2 == 0, "server").otherwise("keeper")},
        F.concat(F.lit("db"), F.col("user_id").cast("string")),
    )


RECORDS = """(SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN props[1:5] ELSE props END AS body,
    CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' ELSE 'Information' END AS level, user_id,
    'clickhouse' AS database, CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'keeper' END AS component,
    'db' || user_id AS host_name FROM events)"""

PARSED = f"""(SELECT *, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.k')::int END AS k FROM {RECORDS})"""


@query("log_json_parse", f"SELECT event_id, body, NOT json_valid(body) AS malformed, k FROM {PARSED}")
def log_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = L.parse_json(log_records(spark, sf), BODY)
    return parsed.select("event_id", "body", "malformed", "parsed.k")


def attribute_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as log bodies. A document's source is one of its keys; the bodies of every seventh lack their last brace."""
    docs = table(spark, sf, "documents")
    doc = F.to_json(F.struct("lang", "text"), {"ignoreNullFields": "false"})
    own = F.concat(
        F.lit(',"'), F.coalesce("source", F.lit("none")), F.lit('":'), F.coalesce(F.col("n_chars").cast("string"), F.lit("null"))
    )
    tags = F.concat(F.lit(',"tags":["'), F.coalesce("lang", F.lit("none")), F.lit('",'), F.col("doc_id").cast("string"), F.lit("]"))
    whole = F.concat(F.lit('{"doc":'), doc, own, tags)
    return docs.select("doc_id", F.concat(whole, F.when(F.col("doc_id") % 7 == 0, "").otherwise("}")).alias("body"))


ATTRIBUTES = """(SELECT *, doc_id % 7 = 0 AS cut, '{"doc":' || json_object('lang', lang, 'text', text) || ',"' || coalesce(source, 'none')
    || '":' || coalesce(n_chars::varchar, 'null') || ',"tags":["' || coalesce(lang, 'none') || '",' || doc_id || ']'
    || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '}' END AS body FROM documents)"""

KIND = """CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
    WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"""


@query(
    "log_attributes",
    f"""SELECT doc_id, false AS malformed, key, {KIND} AS kind,
               CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(v, '$') END AS value
        FROM (SELECT doc_id, key, json_extract(body, '$."' || key || '"') AS v
              FROM (SELECT *, unnest(json_keys(body)) AS key FROM {ATTRIBUTES} WHERE json_valid(body)))
        UNION ALL SELECT doc_id, true, NULL, NULL, NULL FROM {ATTRIBUTES} WHERE NOT json_valid(body)""",
)
def log_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return A.listed(A.parse(attribute_records(spark, sf)), ["doc_id", "malformed"])


@query(
    "log_attribute_search",
    f"""SELECT doc_id, json_extract_string(body, '$.tags[0]') AS tag, length(json_extract_string(body, '$.doc.text'))::bigint AS n_text
        FROM {ATTRIBUTES} WHERE CASE WHEN json_valid(body) THEN json_extract_string(body, '$.doc.lang') = 'en'
          AND json_extract_string(body, '$.src3')::bigint > 500 END""",
)
def log_attribute_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search in stored variants: conditions on keys and the fields returned reach the scan."""
    path = scratch_path(spark, "attributes")
    A.parse(attribute_records(spark, sf)).drop("body").write.parquet(path)
    found = A.search(spark.read.parquet(path), [(["doc", "lang"], "=", "en"), (["src3"], ">", 500)])
    text = A.attribute("attributes", ["doc", "text"])
    return found.select("doc_id", A.attribute("attributes", ["tags", 0]).alias("tag"), F.length(text).cast("bigint").alias("n_text"))


@query(
    "log_attribute_keys",
    f"""SELECT key, {KIND} AS kind, count(*) AS n_rows
        FROM (SELECT key, json_extract(body, '$."' || key || '"') AS v
              FROM (SELECT *, unnest(json_keys(body)) AS key FROM {ATTRIBUTES} WHERE json_valid(body))) GROUP BY 1, 2""",
)
def log_attribute_keys(spark: SparkSession, sf: str) -> DataFrame:
    return A.key_profile(A.parse(attribute_records(spark, sf)))


PATCH = """'{"doc":' || CASE doc_id % 3 WHEN 0 THEN '{"lang":"xx"},"tags":[' || doc_id || ']}'
    WHEN 1 THEN '{"size":{"chars":' || doc_id || '}},"extra":{"a":{"b":true}}}' ELSE '"gone","tags":{"k":' || doc_id || '}}' END"""


@query(
    "document_merge",
    f"""SELECT doc_id, json_extract_string(m, '$.doc.lang') AS lang, length(json_extract_string(m, '$.doc.text'))::bigint AS n_text,
               json_extract_string(m, '$.doc.size.chars') AS chars, json_extract(m, '$.tags')::varchar AS tags,
               json_extract_string(m, '$.extra.a.b') AS extra, json_type(m, '$.doc') = 'OBJECT' AS nested
        FROM (SELECT doc_id, CASE WHEN json_valid(body) THEN json_merge_patch(body, patch) ELSE patch::json END AS m
              FROM (SELECT doc_id, body, {PATCH} AS patch FROM {ATTRIBUTES}))""",
)
def document_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A patch for every document: a scalar and a list replaced, branches added, a branch replaced by a scalar."""
    base = attribute_records(spark, sf)
    merged = P.merge_documents(base, base.select("doc_id", F.expr(PATCH).alias("body")), ["doc_id"])
    got = A.parse(merged).select(
        "doc_id", "attributes", F.try_variant_get("attributes", "$.doc", "variant").alias("doc"),
        F.try_variant_get("attributes", "$.tags", "variant").alias("tags"),
    )
    return got.select(
        "doc_id",
        A.attribute("doc", ["lang"]).alias("lang"),
        F.length(A.attribute("doc", ["text"])).cast("bigint").alias("n_text"),
        A.attribute("doc", ["size", "chars"]).alias("chars"),
        F.to_json("tags").alias("tags"),
        A.attribute("attributes", ["extra", "a", "b"]).alias("extra"),
        (A.kind_of(F.col("doc")) == "object").alias("nested"),
    )


@query("log_enrich", f"SELECT event_id, database, component, host_name, body FROM {RECORDS}")
def log_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return log_records(spark, sf).select("event_id", "database", "component", "host_name", "body")


@query(
    "log_search",
    f"""SELECT event_id, ts, level, body FROM {RECORDS} WHERE database = 'clickhouse' AND level = 'Error'
        AND ts > (SELECT max(ts) - INTERVAL 5 DAY FROM events)""",
)
def log_search(spark: SparkSession, sf: str) -> DataFrame:
    recent = relative_range(log_records(spark, sf), timedelta(days=5))
    return L.search(recent, {"database": "clickhouse", "level": "Error"}, "ts", "event_id").select("event_id", "ts", "level", "body")


@query(
    "log_adhoc_filter",
    f"""SELECT event_id, level, k FROM {PARSED} WHERE level <> 'Information' AND k > 50 AND component = 'keeper'
        AND regexp_matches(host_name, '^db[0-9]$')""",
)
def log_adhoc_filter(spark: SparkSession, sf: str) -> DataFrame:
    flat = L.parse_json(log_records(spark, sf), BODY).select("*", "parsed.k")
    terms = [("level", "!=", "Information"), ("k", ">", 50), ("component", "=", "keeper"), ("host_name", "=~", "^db[0-9]$")]
    return L.adhoc_filter(flat, terms).select("event_id", "level", "k")


@query(
    "context_search",
    r"""WITH raw AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line,
                            generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS n FROM documents),
       kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS line_no FROM raw
                WHERE NOT regexp_matches(line, '^\s*#[^:]*$')),
       marked AS (SELECT *, regexp_matches(line, '(?i)license') AS is_match FROM kept)
       SELECT doc_id, line_no, line, is_match FROM (
         SELECT *, max(is_match::int) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near
         FROM marked) WHERE near = 1 AND regexp_matches(line, '\S')""",
)
def context_search(spark: SparkSession, sf: str) -> DataFrame:
    return L.context_search(table(spark, sf, "documents"), "doc_id", "text", "license")


def raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as tool output: coloured role, several lines."""
    kind = F.when(F.col("role") == "system", "error").otherwise("message")
    raw = F.concat(F.lit("\x1b[1;33m "), F.col("role"), F.lit("\x1b[0m \r\n\t"), F.col("text"), F.lit("\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("event_type"), raw.alias("raw"))


@query(
    "message_clean",
    r"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'ERROR: ' ELSE '' END ||
          trim(regexp_replace(regexp_replace(regexp_replace(chr(27) || '[1;33m ' || role || chr(27) || '[0m ' || chr(13) || chr(10)
            || chr(9) || text || chr(10), '\x1b\[[0-9;]*[a-zA-Z]', '', 'g'), '[\r\n]+', ' ', 'g'), '\s+', ' ', 'g')) AS message
       FROM conversations""",
)
def message_clean(spark: SparkSession, sf: str) -> DataFrame:
    return raw_messages(spark, sf).select(
        "conv_id", "turn", event_message(F.col("event_type"), F.col("raw")).alias("message")
    )


@query(
    "progress_sample",
    """SELECT event_type AS run_id, event_id, frame_count,
              'Docker container activity: ' || frame_count || ' frames processed' AS message
       FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS frame_count FROM events)
       WHERE frame_count % 100 = 0""",
)
def progress_sample(spark: SparkSession, sf: str) -> DataFrame:
    frames = table(spark, sf, "events").select(F.col("event_type").alias("run_id"), "event_id")
    return L.progress(frames, ["run_id"], ["event_id"])


@query(
    "log_tail_n",
    """SELECT conv_id, turn, text FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 2""",
)
def log_tail_n(spark: SparkSession, sf: str) -> DataFrame:
    return L.tail(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", 2)


@query(
    "service_map_edges",
    """SELECT p.role AS caller, c.role AS callee, count(*) AS n_calls
       FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 GROUP BY 1, 2""",
)
def service_map_edges(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"), "role"
    )
    return L.service_edges(spans, "conv_id", "turn", "parent", "role")


@query(
    "log_daily_index",
    """SELECT 'logs-otel-' || strftime(ts, '%Y.%m.%d') AS "index", count(*) AS n_lines, sum(event_id)::bigint AS id_sum
       FROM events GROUP BY 1""",
)
def log_daily_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "daily-index")
    tables.write_daily_index(table(spark, sf, "events").select("event_id", "ts", "props"), path)
    stored = tables.read_daily_index(spark, path)
    return stored.groupBy("index").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("event_id").alias("id_sum"))


@query(
    "retention_expire",
    """SELECT 'logs-otel-' || strftime(ts, '%Y.%m.%d') AS "index", count(*) AS n_lines, sum(event_id)::bigint AS id_sum
       FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 7 DAY FROM events) GROUP BY 1""",
)
def retention_expire(spark: SparkSession, sf: str) -> DataFrame:
    """A store by day from which everything older than seven days before the newest day is deleted."""
    path = scratch_path(spark, "kept-index")
    events = table(spark, sf, "events").select("event_id", "ts", "props")
    tables.write_daily_index(events, path)
    oldest = events.select(L.daily_index(F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 7 DAYS"))).first()[0]
    tables.expire_daily_index(spark, path, oldest)
    kept = tables.read_daily_index(spark, path)
    return kept.groupBy("index").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("event_id").alias("id_sum"))


@query(
    "doc_upsert_latest",
    """SELECT user_id, event_id, ts, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn = 1""",
)
def doc_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    stored, new = events.where(F.col("event_type") != "view"), events.where(F.col("event_type") == "view")
    return tables.put_documents(stored, new, ["user_id"], "ts", "event_id")


@query(
    "log_file_scan",
    f"""SELECT component, count(*) AS n_lines, count(*) FILTER (NOT json_valid(body)) AS n_malformed, sum(k)::bigint AS k_sum
        FROM {PARSED} GROUP BY 1""",
)
def log_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "log-lines")
    lines = log_records(spark, sf).select("component", "body")
    lines.hint("rebalance", "component").write.partitionBy("component").text(folder)
    read = L.parse_json(files.log_lines(spark, folder, "part-*"), BODY)
    component = F.regexp_extract("file_path", "component=([^/]+)/", 1)
    return read.groupBy(component.alias("component")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("malformed").alias("n_malformed"),
        F.sum("parsed.k").alias("k_sum"),
    )


LAYOUT = r"([^/]+)/step=([^/]+)/log=(stdout|stderr)/part-[^/]*\.gz$"


def step_logs(spark: SparkSession, sf: str, *logs: str) -> DataFrame:
    """Conversation texts written as gzipped step logs, one file for each log in order of turns, and read back.

    Every line begins with its conversation and turn.
    """
    folder = scratch_path(spark, "step-logs")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 100).alias("step"),
        F.when(F.col("role") == "user", "stdout").otherwise("stderr").alias("log"),
        "conv_id",
        "turn",
        name.alias("name"),
        line.alias("line"),
    )
    sorted_turns = turns.repartition("step", "log").sortWithinPartitions("step", "log", "conv_id", "turn")
    lines = sorted_turns.select("step", "log", F.concat_ws(" ", "name", "line").alias("value"))
    lines.write.partitionBy("step", "log").option("compression", "gzip").text(folder)
    return files.step_logs(spark, folder, LAYOUT, logs or ("stdout", "stderr"))


STEP_LINES = """(SELECT (conv_id % 100)::varchar AS step_id, CASE role WHEN 'user' THEN 'stdout' ELSE 'stderr' END AS log,
    conv_id, turn, conv_id || ':' || turn || ' ' || unnest(string_split(coalesce(text, ''), chr(10))) AS line
    FROM conversations)"""


@query(
    "step_log_tail",
    f"""SELECT step_id, conv_id || ':' || turn AS line_of, count(*) AS n_lines FROM (
         SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY conv_id DESC, turn DESC) AS n
         FROM {STEP_LINES} WHERE log = 'stderr') WHERE n <= 10 GROUP BY 1, 2""",
)
def step_log_tail(spark: SparkSession, sf: str) -> DataFrame:
    last = files.step_log_tail(step_logs(spark, sf, "stderr"), 10)
    return last.groupBy("step_id", F.substring_index("line", " ", 1).alias("line_of")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("step_log_scan", f"SELECT step_id, log, line FROM {STEP_LINES}")
def step_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    return step_logs(spark, sf).select("step_id", "log", "line")


@query(
    "log_search_skipping",
    r"""SELECT doc_id, source, lang, n_chars FROM documents
        WHERE lang = 'en' AND n_chars BETWEEN 200 AND 20000
          AND regexp_matches(text, '(^|[^A-Za-z0-9_])(?i:license)([^A-Za-z0-9_]|$)')
          AND regexp_matches(text, '(^|[^A-Za-z0-9_])(?i:under)([^A-Za-z0-9_]|$)')""",
)
def log_search_skipping(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stored by source with a skipping index, searched for two words in texts of one language and range of lengths."""
    store, index = scratch_path(spark, "texts"), scratch_path(spark, "texts-index")
    documents = table(spark, sf, "documents")
    documents.hint("rebalance", "source").write.partitionBy("source").parquet(store)
    skipping.index_files(spark, store, index, "text", ["lang"], ["n_chars"])
    wanted = {"has": ["license", "under"], "equal": {"lang": "en"}, "between": {"n_chars": (200, 20000)}}
    return skipping.search_store(spark, store, index, "text", **wanted).select("doc_id", "source", "lang", "n_chars")
