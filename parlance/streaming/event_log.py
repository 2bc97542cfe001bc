"""An append-only log of events in files, read and written by streams: groups with their own place, and retention."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

FORMAT = "parlance_events"
SCHEMA = "number bigint, line int, value string"
_NAME = re.compile(r"(\d{12})\.(.+)\.jsonl$")


def _fs(uri: str):
    """(file system, path) of a folder, by Arrow's file systems (local, HDFS, S3, GCS, Azure)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _listed(uri: str) -> list[tuple[int, str, str]]:
    """(number, writer's mark, path) of the log's files, in order."""
    from pyarrow import fs

    files, at = _fs(uri)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((int(m[1]), m[2], f.path) for f in found if (m := _NAME.search(f.base_name)))


def committed(uri: str, group: str) -> int | None:
    """The number up to which a group has taken the log; None if it never has."""
    from pyarrow import fs

    files, at = _fs(uri)
    info = files.get_file_info(f"{at}/groups/{group}.json")
    if info.type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(info.path) as stream:
        return json.loads(stream.read())["number"]


@dataclass
class _File(InputPartition):
    number: int
    path: str


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.group, self.start = options["path"], options.get("group"), options.get("start", "latest")
        if self.start not in ("latest", "earliest"):
            raise ValueError("start is latest or earliest")

    def _last(self) -> int:
        return max((n for n, *_ in _listed(self.uri)), default=0)

    def initialOffset(self) -> dict:
        known = committed(self.uri, self.group) if self.group else None
        place = {"number": known if known is not None else self._last() if self.start == "latest" else 0}
        if self.group and known is None:
            self.commit(place)  # the group begins here, whatever becomes of this query
        return place

    def latestOffset(self, *_) -> dict:
        return {"number": self._last()}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(n, path) for n, _, path in _listed(self.uri) if start["number"] < n <= end["number"]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        files, _ = _fs(self.uri)
        with files.open_input_stream(partition.path) as raw:
            held, line = [], 0
            for text in _lines(raw):
                held.append((partition.number, line, text))
                line += 1
                if len(held) == 1000:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)

    def commit(self, end: dict) -> None:
        if self.group:
            files, at = _fs(self.uri)
            files.create_dir(f"{at}/groups", recursive=True)
            fresh = f"{at}/groups/.{self.group}.{uuid.uuid4().hex}"
            with files.open_output_stream(fresh) as out:
                out.write(json.dumps(end).encode())
            files.move(fresh, f"{at}/groups/{self.group}.json")


def _lines(raw) -> Iterator[str]:
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode() for x in whole)
    if rest:
        yield rest.decode()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    number, line, value = zip(*rows)
    return pa.record_batch([pa.array(number, pa.int64()), pa.array(line, pa.int32()), pa.array(value, pa.string())], names=["number", "line", "value"])


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceStreamWriter):
    """Tasks write hidden files; a batch's commit gives them their numbers, unless that batch has been committed before."""

    def __init__(self, options: dict):
        self.uri, self.mark = options["path"], options.get("writer", "w")

    def write(self, rows: Iterator[Row]) -> _Written:
        files, at = _fs(self.uri)
        files.create_dir(at, recursive=True)
        path, out = f"{at}/.{uuid.uuid4().hex}", None
        for row in rows:
            if out is None:
                out = files.open_output_stream(path)
            out.write((row["value"] or "").encode() + b"\n")
        if out is not None:
            out.close()
        return _Written(path if out is not None else None)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        files, at = _fs(self.uri)
        every, mark = _listed(self.uri), f"{self.mark}-{batchId}"
        there = {m for _, m, _ in every}
        number = max((n for n, *_ in every), default=0)
        for k, message in enumerate(m for m in messages if m and m.path):
            if f"{mark}-{k}" in there:
                files.delete_file(message.path)
                continue
            number += 1
            files.move(message.path, f"{at}/{number:012d}.{mark}-{k}.jsonl")

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        files, _ = _fs(self.uri)
        for message in messages:
            if message and message.path:
                files.delete_file(message.path)


class EventLog(DataSource):
    """A stream source and sink over a folder of numbered files of JSON lines.

    Options: path; group (a name whose place outlives its queries: a new query
    of the group, without a checkpoint, goes on where the last one committed,
    which Spark does when the next batch is planned, so its last batch comes again), start (latest or
    earliest, where a group begins that has no place yet), writer (the name by
    which a query's batches are known, so that a batch that is done again is
    not written twice). Rows read: number, line, value; written: value.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(EventLog)


def trim(uri: str, most: int, groups: tuple[str, ...] = ()) -> int:
    """Delete the oldest files beyond `most`, but none that one of the groups hasn't taken yet; how many went."""
    files, _ = _fs(uri)
    every, taken = _listed(uri), min((committed(uri, g) or 0 for g in groups), default=None)
    old = [path for n, _, path in every[: max(0, len(every) - most)] if taken is None or n <= taken]
    for path in old:
        files.delete_file(path)
    return len(old)
