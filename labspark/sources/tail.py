"""Log files that grow: every complete line is read once, however often its file is looked at.

A streaming source in Python, as Spark's own file streams take whole new files only. Its offset is a ledger: for each file how
far it was read, always to the end of a line, and a mark of the bytes before that place. The checkpoint keeps the ledgers, so a
stream that starts anew goes on where it was. A file whose bytes no longer fit its mark was rotated: its new content is read
from the start, and what the old one still held is read where it went, if a file beside it fits the mark.

The ledger has one entry for each file there is; files that are gone leave it. Planning a batch reads a few bytes of each file
that has changed. What has grown is cut into ranges, and Spark's tasks read those.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from labspark.session import visible_to_workers

LINE = "body string, file_path string, file_name string, line_at bigint"
#: Bytes of a range that a task reads, of a look back for the end of a line, and of a mark.
RANGE_BYTES = 64 << 20
LOOK_BYTES = 1 << 16
MARK_BYTES = 1024
BATCH_LINES = 8192


@dataclass
class Range(InputPartition):
    """Lines that begin from ``start`` to before ``stop``; ``first`` if a line is known to begin at ``start``."""

    path: str
    start: int
    stop: int
    first: bool


class GrownFiles(DataSource):
    """The source: ``path``, a folder; ``pattern`` of file names; ``startAt``, ``beginning`` or ``end``."""

    @classmethod
    def name(cls) -> str:
        return "grown_files"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema: object) -> GrownFilesReader:
        # Options come with keys of any case.
        options = {key.lower(): value for key, value in self.options.items()}
        return GrownFilesReader(options["path"], options.get("pattern", "*.log"), options.get("startat", "beginning"))


class GrownFilesReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, start_at: str) -> None:
        if start_at not in ("beginning", "end"):
            raise ValueError(f"startAt is beginning or end, not {start_at}")
        self.folder, self.pattern, self.start_at = folder, pattern, start_at
        self.seen: dict[str, tuple[int, int | None, dict]] = {}

    def _open(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:
        return {"files": self._ledger() if self.start_at == "end" else {}}

    def latestOffset(self) -> dict:
        return {"files": self._ledger()}

    def _ledger(self) -> dict[str, dict]:
        store, root = self._open()
        out = {}
        for info in store.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if not info.is_file or not fnmatch.fnmatchcase(info.base_name, self.pattern):
                continue
            size, changed, entry = self.seen.get(info.path, (-1, None, {}))
            if (size, changed) != (info.size, info.mtime_ns) or changed is None:
                try:
                    end = last_line_end(store, info.path, info.size)
                    entry = {"end": end, "mark": mark(store, info.path, end)}
                except FileNotFoundError:
                    continue
                self.seen[info.path] = (info.size, info.mtime_ns, entry)
            out[info.path] = entry
        self.seen = {path: known for path, known in self.seen.items() if path in out}
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        store, _ = self._open()
        before, now = start["files"], end["files"]
        begins = {p: e["end"] for p, e in before.items() if p in now and continues(store, p, e, now[p])}
        gone = {p: e for p, e in before.items() if p not in begins and e["end"] > 0}
        for path, entry in now.items():
            if path not in begins:
                beside = [p for p in gone if folder_of(p) == folder_of(path) and continues(store, path, gone[p], entry)]
                begins[path] = gone.pop(max(beside, key=lambda p: gone[p]["end"]))["end"] if beside else 0
        ranges = []
        for path, entry in sorted(now.items()):
            for at in range(begins[path], entry["end"], RANGE_BYTES):
                ranges.append(Range(path, at, min(at + RANGE_BYTES, entry["end"]), at == begins[path]))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        names = ["body", "file_path", "file_name", "line_at"]
        with store.open_input_file(partition.path) as file:
            rows: list[tuple[str, int]] = []

            def batch() -> pa.RecordBatch:
                n = len(rows)
                columns = [[r[0] for r in rows], [partition.path] * n, [partition.path.rsplit("/", 1)[-1]] * n]
                return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([r[1] for r in rows], pa.int64())], names)

            for line, at in lines_of(file, partition):
                rows.append((line.removesuffix(b"\r").decode("utf-8", "replace"), at))
                if len(rows) == BATCH_LINES:
                    yield batch()
                    rows = []
            if rows:
                yield batch()


def lines_of(file: pa.NativeFile, part: Range) -> Iterator[tuple[bytes, int]]:
    """The lines that begin in a range, and where. Another range reads the line that the start may lie in."""
    at = part.start if part.first else part.start - 1
    file.seek(at)
    rest, skipping = b"", not part.first
    while True:
        data = file.read(LOOK_BYTES * 16)
        if not data:
            return
        pieces = (rest + data).split(b"\n")
        rest = pieces.pop()
        for piece in pieces:
            if not skipping:
                if at >= part.stop:
                    return
                yield piece, at
            at, skipping = at + len(piece) + 1, False
        if at >= part.stop:
            return


def folder_of(path: str) -> str:
    return path.rsplit("/", 1)[0]


def last_line_end(store: pa.fs.FileSystem, path: str, size: int) -> int:
    """Where the last complete line of the file's first ``size`` bytes ends."""
    with store.open_input_file(path) as file:
        stop = min(size, file.size())
        while stop > 0:
            start = max(0, stop - LOOK_BYTES)
            at = file.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


def mark(store: pa.fs.FileSystem, path: str, end: int) -> str:
    """A digest of the last bytes before ``end``."""
    with store.open_input_file(path) as file:
        start = max(0, end - MARK_BYTES)
        return hashlib.sha256(file.read_at(end - start, start)).hexdigest()[:16]


def continues(store: pa.fs.FileSystem, path: str, before: dict, now: dict) -> bool:
    """Whether the file at ``path`` has what was read when ``before`` was noted."""
    if now["end"] < before["end"]:
        return False
    return now == before or before["end"] == 0 or mark(store, path, before["end"]) == before["mark"]


def tail(spark: SparkSession, folder: str, pattern: str = "*.log", start_at: str = "beginning") -> DataFrame:
    """A stream of the lines that files below ``folder`` get: ``body``, ``file_path``, ``file_name``, ``line_at`` (its byte).

    A line counts once it has its end; a last line without one is held back until it has. With ``start_at`` ``end``, lines
    complete before the stream first starts are left out; files that come later are read whole. The folder may be of any file
    system that pyarrow knows, under one path for the driver and all workers. A file is told by its path and content: one that
    is replaced, cut or renamed within its folder is noticed unless the last kilobyte read is the same in both.
    """
    visible_to_workers(spark)
    spark.dataSource.register(GrownFiles)
    return spark.readStream.format(GrownFiles.name()).option("pattern", pattern).option("startAt", start_at).load(folder)
