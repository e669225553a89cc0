"""Skipping indexes: searches that leave out the files of a store that can't hold what is sought.

For each Parquet file of a store the index has the ends of some columns (zones) and a Bloom filter of its tokens: the words of
a text column and the values of exact columns. A search lists the files, drops those whose entry rules them out and reads the
rest with the same conditions, so the index never changes a result. A file without an entry, or one written anew since, is read.

A token is a number of 63 bits. A file's filter is cut into bitmaps of 32,768 bits, each for one range of tokens, as many as its
number of different tokens asks for. They are stored in the order of their ranges: a lookup reads the bitmaps whose range holds
the token, about one a file, not the index. A commit log (``sources.commits``) names the runs that count, so a run that failed
is not seen.

The names of the files to read reach the driver, as those of all files do in any scan.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.plans.hotgroups import settled
from labspark.sources.commits import commit, delete, latest, names, publish
from labspark.sources.files import plain_path

# Fixed value: the bits of one bitmap that Spark's bitmap functions make.
BITMAP = 32_768
TOP = (1 << 63) - 1
BITS_PER_TOKEN = 12
PROBES = 4
MAX_LEVEL = 40

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EXACT_TYPES = (T.StringType, T.IntegralType, T.DateType, T.BooleanType)


def words(text: Column) -> Column:
    """The different words of a text, runs of ASCII letters, digits and underscores with A-Z lowered; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9_]+"), F.lit(0)))


def has_word(text: Column, word: str) -> Column:
    """Whether a text has the word, whatever the case of its ASCII letters."""
    if not re.fullmatch("[A-Za-z0-9_]+", word):
        raise ValueError(f"{word!r} is not one word")
    return text.rlike(f"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")


def _token(kind: str, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), value).bitwiseAND(F.lit(TOP))


def _tokens(schema: T.StructType, text: str | None, exact: Sequence[str]) -> Column:
    found = [F.array().cast("array<bigint>")]
    if text is not None:
        found.append(F.transform(words(F.col(text)), lambda word: _token("word", word)))
    for name in exact:
        if not isinstance(schema[name].dataType, EXACT_TYPES):
            raise TypeError(f"{name}: equal values must have equal texts")
        found.append(F.array(F.when(F.col(name).isNotNull(), _token(f"={name}", F.col(name).cast("string")))))
    return F.array_compact(F.concat(*found))


def _probes(token: Column) -> Column:
    """The bits of a token in its bitmap."""
    return F.array(*[F.pmod(F.xxhash64(token, F.lit(i)), F.lit(BITMAP)) for i in range(PROBES)])


def _file_id() -> Column:
    """A file as it is now. Files that share a number by chance share an entry that fits both."""
    return F.xxhash64(*[f"_metadata.file_{part}" for part in ("path", "size", "modification_time")])


def listed(spark: SparkSession, store: str) -> DataFrame:
    """The store's files, ``path`` and ``file``; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(store)
    return found.select(F.col("_metadata.file_path").alias("path"), _file_id().alias("file"))


def _state(spark: SparkSession, index: str) -> tuple[int, dict | None]:
    return latest(spark, f"{index}/_log") or (-1, None)


def _publish(spark: SparkSession, index: str, add: str, columns: dict, instead: Sequence[str] = ()) -> None:
    """Name a run, in place of others; another writer's commit in between is built upon."""
    while True:
        number, state = _state(spark, index)
        runs = [run for run in (state["runs"] if state else []) if run not in instead]
        if publish(spark, f"{index}/_log", number + 1, {**columns, "runs": [*runs, add]}):
            return


def _rows(spark: SparkSession, index: str, runs: Sequence[str], kind: str) -> DataFrame:
    return spark.read.parquet(*[f"{index}/{run}/{kind}" for run in runs])


def _read_files(spark: SparkSession, store: str, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    """The rows of some files of a store, partition columns included."""
    if not paths:
        return spark.createDataFrame([], schema)
    literal = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", path) for path in paths]
    return spark.read.schema(schema).option("basePath", store).parquet(*literal)


def index_files(
    spark: SparkSession, store: str, index: str, text: str | None = None, exact: Sequence[str] = (), zones: Sequence[str] = ()
) -> int:
    """Index the files that have no entry yet; how many there were.

    ``text`` names a column whose words can be sought, ``exact`` those whose values can, ``zones`` those whose ranges can. All
    runs of an index take the same columns.
    """
    columns = {"text": text, "exact": list(exact), "zones": list(zones)}
    _, state = _state(spark, index)
    if state and {name: state[name] for name in columns} != columns:
        raise ValueError(f"the index has other columns: {state}")
    new = listed(spark, store)
    if state:
        new = new.join(_rows(spark, index, state["runs"], "files").select("file"), "file", "left_anti")
    paths = [row[0] for row in new.select(plain_path(F.col("path"))).collect()]
    if not paths:
        return 0
    schema = spark.read.parquet(store).schema
    rows = _read_files(spark, store, schema, paths).select("*", _file_id().alias("_file"))
    tokens = _tokens(schema, text, exact)
    # A file's tokens, each once: read twice, for their number and for the bits.
    known = settled(rows.select(F.col("_file").alias("file"), F.explode(tokens).alias("token")).distinct())
    wanted = F.log2(F.col("n_tokens") * F.lit(BITS_PER_TOKEN / BITMAP))
    level = F.least(F.greatest(F.ceil(wanted), F.lit(0)), F.lit(MAX_LEVEL)).cast("int")
    sizes = known.groupBy("file").agg(F.count(F.lit(1)).alias("n_tokens")).withColumn("level", level)
    ends = [end(name).alias(f"{side}_{name}") for name in zones for side, end in (("low", F.min), ("high", F.max))]
    run = f"run={uuid.uuid4().hex}"
    # Empty files have no rows, but are files that need not be read again.
    entries = rows.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), *ends)
    files = new.select("file").join(entries, "file", "left").join(sizes.select("file", "n_tokens"), "file", "left")
    files.write.parquet(f"{index}/{run}/files")
    low = F.expr("shiftleft(shiftright(token, 63 - level), 63 - level)")
    bits = (
        known.join(sizes.select("file", "level"), "file")
        .select("file", "level", low.alias("low"), F.explode(_probes(F.col("token"))).alias("bit"))
        .repartition("file", "level", "low")
        .groupBy("file", "level", "low")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
        .withColumn("high", F.col("low").bitwiseOR(F.expr(f"shiftright({TOP}L, level)")))
    )
    ordered = bits.repartitionByRange("level", "low", "file").sortWithinPartitions("level", "low")
    # Small files share the widest ranges, so the file deals them out too. Small row groups, so that a lookup skips most of them by their ranges.
    ordered.write.option("parquet.block.size", 4 << 20).parquet(f"{index}/{run}/bits")
    _publish(spark, index, run, columns)
    return len(paths)


def _set(bits: Column, at: Column) -> Column:
    byte = F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (at % 8).cast("int")) == 1


def _holding(bits: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """Files whose filters have all tokens. The ranges go to the scan as literals."""
    ranges = [(F.col("low") <= F.lit(token)) & (F.col("high") >= F.lit(token)) for token in tokens]
    hits = []
    for token, inside in zip(tokens, ranges):
        probes = [F.pmod(F.xxhash64(F.lit(token), F.lit(i)), F.lit(BITMAP)) for i in range(PROBES)]
        every = reduce(lambda a, b: a & b, [_set(F.col("bits"), probe) for probe in probes])
        hits.append(F.bool_or(inside & every))
    both = bits.where(reduce(lambda a, b: a | b, ranges)).groupBy("file").agg(*[hit.alias(f"h{i}") for i, hit in enumerate(hits)])
    return both.where(reduce(lambda a, b: a & b, [F.col(f"h{i}") for i in range(len(tokens))])).select("file")


def _literal(schema: T.StructType, name: str, value: object) -> Column:
    return F.lit(value).cast(schema[name].dataType)


def candidates(
    spark: SparkSession,
    store: str,
    index: str,
    has: Sequence[str] = (),
    equal: Mapping[str, object] | None = None,
    between: Mapping[str, tuple[object, object]] | None = None,
) -> list[str]:
    """The files that may hold rows with all words ``has``, the ``equal`` values and columns ``between`` two values, ends included."""
    files = listed(spark, store)
    _, state = _state(spark, index)
    if state is None:
        return sorted(row[0] for row in files.select(plain_path(F.col("path"))).collect())
    schema = spark.read.parquet(store).schema
    wanted = [_token("word", F.lit(word.lower())) for word in has] if state["text"] else []
    wanted += [_token(f"={n}", _literal(schema, n, v).cast("string")) for n, v in (equal or {}).items() if n in state["exact"]]
    entries = _rows(spark, index, state["runs"], "files")
    fits = F.lit(True)
    for name, (low, high) in (between or {}).items():
        if name in state["zones"]:
            fits = fits & (F.col(f"low_{name}") <= _literal(schema, name, high)) & (F.col(f"high_{name}") >= _literal(schema, name, low))
    kept = entries.where(fits).select("file")
    if wanted:
        tokens = list(spark.range(1).select(*[token.alias(f"t{i}") for i, token in enumerate(wanted)]).first())
        kept = kept.join(_holding(_rows(spark, index, state["runs"], "bits"), tokens), "file", "left_semi")
    out = files.join(entries.select("file"), "file", "left_anti").unionByName(files.join(kept, "file", "left_semi"))
    return sorted(row[0] for row in out.select(plain_path(F.col("path"))).collect())


def search_store(
    spark: SparkSession,
    store: str,
    index: str,
    text: str | None = None,
    has: Sequence[str] = (),
    equal: Mapping[str, object] | None = None,
    between: Mapping[str, tuple[object, object]] | None = None,
) -> DataFrame:
    """Rows whose ``text`` has all words and whose columns meet the conditions, read from the files that may hold some.

    The files are chosen when the search is made; those written later are not part of it.
    """
    if has and text is None:
        raise ValueError("name the column that must have the words")
    _, state = _state(spark, index)
    # Words of a column that is not the indexed one rule out no file.
    sought = has if state and state["text"] == text else ()
    rows = _read_files(spark, store, spark.read.parquet(store).schema, candidates(spark, store, index, sought, equal, between))
    for word in has:
        rows = rows.where(has_word(F.col(text), word))
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    for name, (low, high) in (between or {}).items():
        rows = rows.where(F.col(name).between(F.lit(low), F.lit(high)))
    return rows


def compact_index(spark: SparkSession, store: str, index: str) -> int:
    """Fold all runs into one, without the entries of files that are gone; the number of entries.

    Runs that neither this commit nor the one before it names are deleted, so a search that has just begun finds its own.
    """
    number, state = _state(spark, index)
    if state is None:
        return 0
    present = listed(spark, store).select("file")
    run = f"run={uuid.uuid4().hex}"
    # Two writers may have indexed a file at once; one entry of it stays, and its bitmaps are joined.
    kept = _rows(spark, index, state["runs"], "files").join(present, "file", "left_semi").dropDuplicates(["file"])
    kept.write.parquet(f"{index}/{run}/files")
    bits = _rows(spark, index, state["runs"], "bits").join(present, "file", "left_semi").dropDuplicates(["file", "level", "low"])
    ordered = bits.repartitionByRange("level", "low", "file").sortWithinPartitions("level", "low")
    ordered.write.option("parquet.block.size", 4 << 20).parquet(f"{index}/{run}/bits")
    _publish(spark, index, run, {name: state[name] for name in ("text", "exact", "zones")}, state["runs"])
    _, now = _state(spark, index)
    before = commit(spark, f"{index}/_log", number)
    for old in names(spark, index):
        if old.startswith("run=") and old not in now["runs"] and old not in before["runs"]:
            delete(spark, f"{index}/{old}")
    return spark.read.parquet(f"{index}/{run}/files").count()
