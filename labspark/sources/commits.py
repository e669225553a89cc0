"""Commit logs: numbered files that say what of a store counts.

A file appears whole, under a name that only one writer can get, after all it names is written. Readers take what the log names
and nothing else, so they never see half of a change.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The path and its file system, as Hadoop knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    at, store = file_system(spark, folder)
    try:
        return sorted(status.getPath().getName() for status in store.listStatus(at))
    except Py4JJavaError as missing:
        if "FileNotFoundException" not in missing.java_exception.getClass().getName():
            raise
        return []


def delete(spark: SparkSession, path: str) -> bool:
    at, store = file_system(spark, path)
    return store.delete(at, True)


def commit_name(number: int) -> str:
    return f"{number:020d}.json"


def publish(spark: SparkSession, log: str, number: int, content: dict) -> bool:
    """Add a commit; false if there is one of this number."""
    at, store = file_system(spark, f"{log}/{commit_name(number)}")
    if store.exists(at):
        return False
    draft, _ = file_system(spark, f"{log}/.draft-{uuid.uuid4().hex}")
    out = store.create(draft, False)
    try:
        out.write(json.dumps(content).encode())
    finally:
        out.close()
    if store.exists(at) or not store.rename(draft, at):
        store.delete(draft, False)
        return False
    return True


def numbers(spark: SparkSession, log: str) -> list[int]:
    """The numbers of all commits, rising."""
    return [int(name[:-5]) for name in names(spark, log) if name.endswith(".json") and not name.startswith(".")]


def commit(spark: SparkSession, log: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{log}/{commit_name(number)}", wholetext=True).first()[0])


def latest(spark: SparkSession, log: str) -> tuple[int, dict] | None:
    """The newest commit and its number."""
    found = numbers(spark, log)
    return (found[-1], commit(spark, log, found[-1])) if found else None
