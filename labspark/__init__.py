"""Spark-first operators for lab telemetry, logs and fleet inventory."""

from labspark.session import scratch_path, session, shared_dir

__all__ = ["scratch_path", "session", "shared_dir"]
