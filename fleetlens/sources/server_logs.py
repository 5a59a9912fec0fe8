"""Error logs and ring-buffer records landed as text, as a data source for batch and stream: format ``server_logs``.

Files lie below ``<path>/ServerName=<name>/``. One kind a path, UTF-8:

* ``errorlog``: ``2024-01-19 11:22:33.45 Logon       Login failed for ...``; lines without a time go on with the entry before.
* ``ringbuffer``: ``<Record type="RING_BUFFER_..." ...>...</Record>`` elements, one after the other.

A file is split by bytes; an entry belongs to the split in which it starts, and is read to its end from there, so a large file is
as many tasks as it has splits and a task holds one block and one entry. Files only grow; a rotated log is landed under a name of its own.
Bytes before the first entry of a file belong to none; a time that is no date gives null.

The files are opened where the tasks run, through Arrow's file systems (a shared mount, HDFS, S3, ...).
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, TimestampNTZType

FORMAT = "server_logs"
SERVER = "ServerName="
NO_SERVER = "__HIVE_DEFAULT_PARTITION__"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of a split, of one read, and of one read on the driver that looks for the last entry of a growing file.
SPLIT, BLOCK, TAIL = 128 << 20, 1 << 20, 1 << 16
ROWS = 4096

SCHEMAS = {
    "errorlog": StructType().add("ServerName", "string").add("LogDate", TimestampNTZType()).add("Process", "string").add("LogText", "string"),
    "ringbuffer": StructType().add("ServerName", "string").add("ring_buffer_type", "string").add("record", "string"),
}
STARTS = {
    "errorlog": re.compile(rb"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{2,6}[ \t]", re.MULTILINE),
    "ringbuffer": re.compile(rb"<Record(?=[\s>])"),
}
ENTRY = re.compile(r"(\S+ \S+)[ \t]+(\S*)[ \t]*(.*)", re.DOTALL)
TYPE = re.compile(r"""<Record\b[^>]*?\btype\s*=\s*["']([^"']*)""")
CLOSE = "</Record>"


def _error_entry(text: str) -> tuple:
    at, process, said = ENTRY.match(text).groups()
    day, fraction = at.split(".")
    try:
        when = datetime.fromisoformat(f"{day}.{fraction:0<6}")
    except ValueError:
        when = None
    return when, process, said.rstrip("\r\n")


def _record(text: str) -> tuple | None:
    end = text.find(CLOSE)
    if end < 0:  # cut off
        return None
    kind = TYPE.match(text)
    return kind and kind[1], text[: end + len(CLOSE)]


PARSE = {"errorlog": _error_entry, "ringbuffer": _record}


def entries(stream, start: re.Pattern, first: int, stop: int, limit: int) -> Iterator[bytes]:
    """The entries of a file that start in [first, stop), none beyond ``limit``, which is an entry's end or the file's."""
    at = max(0, first - 1)  # the byte before tells whether a line begins
    stream.seek(at)
    buffer, inside = b"", False
    while True:
        block = stream.read(min(BLOCK, limit - at - len(buffer)))
        buffer += block
        found = [m.start() for m in start.finditer(buffer) if m.start() or inside or at == 0]
        found = [f for f in found if at + f >= first]
        for a, b in zip(found, found[1:], strict=False):
            if at + a >= stop:
                return
            yield buffer[a:b]
        if found and at + found[-1] >= stop:
            return
        if not block:
            if found:
                yield buffer[found[-1] :]
            return
        inside = bool(found)
        cut = found[-1] if found else max(0, len(buffer) - 64)
        if not found and at + cut >= stop:
            return
        at, buffer = at + cut, buffer[cut:]


@dataclass
class Split(InputPartition):
    path: str
    server: str | None
    first: int
    stop: int
    limit: int


class _Logs:
    """What batch and stream share: the files, their splits, and how a split is read."""

    def __init__(self, options: dict):
        self.path = re.sub(r"^file:/+", "/", options["path"])
        self.kind = options.get("kind", "errorlog")
        self.split = int(options.get("splitbytes", SPLIT))
        self.settle = float(options.get("settleseconds", 60))
        self.servers: set | None = None
        self.since: list = []

    def files(self) -> list[tuple[str, str | None, int, float]]:
        """Path, server, bytes and time of change of every file."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            inner = info.path[len(root.rstrip("/")) :].strip("/").split("/")
            if info.type != fs.FileType.File or inner[-1].startswith(("_", ".")):
                continue
            names = [unquote(p[len(SERVER) :]) for p in inner if p.startswith(SERVER)]
            server = names[-1] if names and names[-1] != NO_SERVER else None
            if self.servers is None or server in self.servers:
                found.append((info.path, server, info.size, info.mtime_ns / 1e9 if info.mtime_ns else 0.0))
        return sorted(found, key=lambda f: f[0])

    def splits(self, path: str, server: str | None, first: int, limit: int) -> list[Split]:
        return [Split(path, server, a, min(a + self.split, limit), limit) for a in range(first, limit, self.split)]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for if there are no splits
            return
        schema, parse = to_arrow_schema(SCHEMAS[self.kind]), PARSE[self.kind]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list = []
        with system.open_input_file(partition.path) as stream:
            for raw in entries(stream, STARTS[self.kind], partition.first, partition.stop, partition.limit):
                row = parse(raw.decode("utf-8", "replace"))
                if row is None or not all(row[0] is not None and later(row[0], bound) for later, bound in self.since):
                    continue
                rows.append((partition.server, *row))
                if len(rows) == ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class LogReader(_Logs, DataSourceReader):
    def partitions(self) -> list[Split]:
        return [s for path, server, size, _ in self.files() for s in self.splits(path, server, 0, size)]


class PushingReader(LogReader):
    """Opens only the files of the servers asked for, and gives Spark only the entries from the time asked for on."""

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ServerName",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.servers = (asked if self.servers is None else self.servers & asked) - {None}
                continue
            naive = isinstance(getattr(f, "value", None), datetime) and f.value.tzinfo is None
            if self.kind == "errorlog" and naive and f.attribute == ("LogDate",):
                if isinstance(f, GreaterThan):
                    self.since.append((datetime.__gt__, f.value))
                    continue
                if isinstance(f, GreaterThanOrEqual):
                    self.since.append((datetime.__ge__, f.value))
                    continue
            yield f


class LogStream(_Logs, DataSourceStreamReader):
    """Offsets are the bytes read of each file. An entry is read once it is whole: when the next one has begun, or
    when its file has not changed for ``settleSeconds``. What comes after that without a time of its own belongs to no entry."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, _ = fs.FileSystem.from_uri(self.path)
        now, out = time.time(), {}
        for path, _, size, changed in self.files():
            end = size if now - changed >= self.settle else self._last_start(system, path, size)
            if end:
                out[path] = end
        return out

    def _last_start(self, system, path: str, size: int) -> int:
        """Where the last entry of a file starts; its tail is read in pieces that double."""
        tail = TAIL
        with system.open_input_file(path) as stream:
            while True:
                at = max(0, size - tail)
                stream.seek(at)
                found = [m.start() for m in STARTS[self.kind].finditer(stream.read(size - at)) if m.start() or not at]
                if found or not at:
                    return at + found[-1] if found else 0
                tail *= 2

    def partitions(self, start: dict, end: dict) -> list[Split]:
        servers = {path: server for path, server, _, _ in self.files()}
        return [s for p, limit in sorted(end.items()) if p in servers for s in self.splits(p, servers[p], start.get(p, 0), max(limit, start.get(p, 0)))]

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches."""


class ServerLogs(DataSource):
    """Options: ``path``, ``kind`` (errorlog, ringbuffer), ``splitBytes``, ``settleSeconds`` (streams), ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return SCHEMAS[self.options.get("kind", "errorlog")]

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else LogReader)(dict(self.options.items()))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LogStream(dict(self.options.items()))


def read_logs(spark: SparkSession, path: str, kind: str = "errorlog", **options) -> DataFrame:
    """Landed logs as a frame. With ``spark.sql.python.filterPushdown.enabled`` filters on ServerName skip files and those on LogDate skip entries."""
    spark.dataSource.register(ServerLogs)
    pushdown = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format(FORMAT).options(path=path, kind=kind, pushdown=pushdown, **options).load()


def stream_logs(spark: SparkSession, path: str, kind: str = "errorlog", **options) -> DataFrame:
    """Landed logs as a stream of whole entries."""
    spark.dataSource.register(ServerLogs)
    return spark.readStream.format(FORMAT).options(path=path, kind=kind, **options).load()
