"""Token ids in flat unsigned integer files with 64-bit document offsets, read through memory maps.

A folder holds, for each part: ``part-N.ids`` (the ids, one behind the other), ``part-N.ends`` (where each document ends in
it) and ``part-N.docs`` (the document ids); the last two are signed 64-bit. All numbers are little-endian. ``manifest``, a
Parquet table, has a row for each part: its counts, the width of an id and its bases, which are the sums of the parts
before it. A document's place in the whole is its base plus its place in the part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm import tokens

#: Stands for a null document id.
NO_ID = -(1 << 63)
MANIFEST = "part int, docs long, tokens long, width int, base_docs long, base_tokens long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
) -> None:
    """Encode each text, append ``end_id`` and write all ids in ascending document order.

    A null text is empty and has the end id alone. Null document ids come first; rows that share one are ordered by a hash
    of their text and the text. An empty table gives a manifest without rows.

    Texts are dealt to parts by ranges of the document id, so a part is one sorted stretch. A task writes its files under
    a name of its own and renames them: a task that runs again writes the same bytes. Only the counts, one row for each
    part, reach the driver, which sums them to bases.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name, own = f"{path}/part-{part:06d}", f"{path}/.{part:06d}-{uuid.uuid4().hex}"
        written, count, width = 0, 0, 0
        with store.open_output_stream(f"{own}.ids") as ids_out, store.open_output_stream(f"{own}.ends") as ends_out:
            with store.open_output_stream(f"{own}.docs") as docs_out:
                for batch in batches:
                    ends = []
                    for ids in tokens.encoded(batch, "text", tokenizer, end_id):
                        width = ids.dtype.itemsize
                        ids_out.write(ids.tobytes())
                        written += len(ids)
                        ends.append(written)
                    count += len(ends)
                    ends_out.write(np.array(ends, "<i8").tobytes())
                    docs_out.write(np.array(batch.column("id").fill_null(NO_ID), "<i8").tobytes())
        for kind in ("ids", "ends", "docs"):
            store.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [count], "tokens": [written], "width": [width]})

    counts = ordered.mapInArrow(write, "part long, docs long, tokens long, width long").where("docs > 0")
    sums = sorted(tuple(row) for row in counts.collect())
    bases = zip(accumulate((s[1] for s in sums), initial=0), accumulate((s[2] for s in sums), initial=0))
    manifest = spark.createDataFrame([(*s, *b) for s, b in zip(sums, bases)], MANIFEST)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: a memory map on a local or mounted store, else its bytes in a buffer."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), kind)


def _read(spark: SparkSession, folder: str, schema: str, shape) -> DataFrame:
    """``shape(ids)`` of each document, a list of them at a time, behind its id, start and length."""
    folder = qualified(spark, folder)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()
    places = {i: (r.part, r.base_tokens, r.width) for i, r in enumerate(rows)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                part, base, width = places[i]
                name = f"{path}/part-{part:06d}"
                ids = _mapped(store, f"{name}.ids", f"<u{width}")
                ends = _mapped(store, f"{name}.ends", "<i8")
                names = _mapped(store, f"{name}.docs", "<i8")
                for first in range(0, len(ends), 1000):
                    stops = ends[first : first + 1000]
                    starts = np.concatenate([[ends[first - 1] if first else 0], stops[:-1]])
                    some = names[first : first + 1000]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(some, mask=some == NO_ID),
                            "start": pa.array(starts + base),
                            "n_tokens": pa.array(stops - starts),
                            "shaped": shape([ids[a:b].astype("<u4") for a, b in zip(starts.tolist(), stops.tolist())]),
                        }
                    )

    parts = spark.range(0, len(rows), 1, max(1, len(rows)))
    return parts.mapInArrow(read, f"doc_id long, start long, n_tokens long, shaped {schema}")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a folder: ``doc_id``, ``start``, ``n_tokens`` and its ``ids``."""

    def lists(ids: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids).astype(np.int64)))

    return _read(spark, folder, "array<long>", lists).withColumnRenamed("shaped", "ids")


def read_token_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a folder: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``, of its ids as 32-bit integers."""

    def sums(ids: list[np.ndarray]) -> pa.Array:
        return pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())

    return _read(spark, folder, "long", sums).withColumnRenamed("shaped", "ids_crc32")
