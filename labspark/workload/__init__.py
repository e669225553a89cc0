"""The operators applied to the test tables, each with the SQL that must give the same rows."""

from labspark.workload import hosts, images, logs, manifests, metrics, prefixes, streams
from labspark.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "hosts", "images", "logs", "manifests", "metrics", "prefixes", "streams"]
