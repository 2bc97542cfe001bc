"""Stored tables that change: committed segments of rows, tombstones for what is replaced or removed, and compaction."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Digits of a segment's number in names.
_DIGITS = 12


class SegmentLog:
    """A folder of numbered segments, which any number of readers and one writer at a time may use.

    A segment holds tables and the keys that it takes out of all segments before
    it. Its files are written under a name of their own; it counts once its
    number stands in the folder of commits, which is written last and can't be
    written twice. So a job that dies leaves nothing that a reader sees, and of
    two writers the later one fails. A segment may bear the name of the work that
    made it: work whose name has been committed changes nothing when it is
    done again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def history(self) -> list[dict]:
        """All commits in order: number, folder, tables (name to schema), whether it is a base, work."""
        fs, at = self._at("commits")
        if not fs.exists(at):
            return []
        out: list[dict] = []
        for status in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName()):
            stream = fs.open(status.getPath())
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if not text.endswith("\n"):  # being written
                break
            out.append(json.loads(text))
        return out

    def commits(self) -> list[dict]:
        """The commits that make up the tables: the last base and what came after it."""
        every = self.history()
        return every[max((k for k, c in enumerate(every) if c["base"]), default=0) :]

    def _next(self) -> int:
        fs, at = self._at("commits")
        return 1 + max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=0) if fs.exists(at) else 1

    def append(self, tables: dict[str, DataFrame], removed: DataFrame | None = None, work: str | None = None, base: bool = False, partitions: dict[str, str] | None = None, made_by: str | None = None) -> int | None:
        """Write tables, and the keys (column key) whose rows in earlier segments are gone, as one segment.

        Returns its number, or None if the work was done before. partitions names
        the column by which a table's files are parted, made_by what the rows
        were made with.
        """
        if work is not None and any(c["work"] == work for c in self.history()):
            return None
        number = self._next()
        folder = f"{number:0{_DIGITS}d}-{uuid.uuid4().hex}"
        if removed is not None:
            tables = {**tables, "removed": removed.select("key").distinct()}
        for name, rows in tables.items():
            writer = rows.write.option("compression", "zstd")
            (writer.partitionBy(partitions[name]) if name in (partitions or {}) else writer).parquet(f"{self.path}/{folder}/{name}")
        commit = {"number": number, "folder": folder, "tables": {name: rows.schema.json() for name, rows in tables.items()}, "base": base, "work": work, "parted": sorted(partitions or {}), "made_by": made_by}
        fs, at = self._at(f"commits/{number:0{_DIGITS}d}")
        stream = fs.create(at, False)  # fails if the number is taken
        stream.write(bytearray(json.dumps(commit).encode() + b"\n"))
        stream.close()
        return number

    def table(self, name: str) -> DataFrame | None:
        """All rows of a table in all segments, with the segment's number; None before there are any."""
        commits = [c for c in self.commits() if name in c["tables"]]
        if not commits:
            return None
        schema = StructType.fromJson(json.loads(commits[-1]["tables"][name]))
        paths = [f"{self.path}/{c['folder']}/{name}" for c in commits]
        if name in commits[-1]["parted"]:  # one reader takes parted files of one root only
            each = [self.spark.read.schema(schema).parquet(path).withColumn("segment", F.lit(c["number"]).cast("long")) for path, c in zip(paths, commits)]
            return reduce(DataFrame.unionByName, each)
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.withColumn("segment", F.regexp_extract("_metadata.file_path", rf"/([0-9]{{{_DIGITS}}})-[0-9a-f]{{32}}/", 1).cast("long"))

    def removals(self) -> DataFrame | None:
        """(key, removed_at): the last segment that took the key out of those before it."""
        rows = self.table("removed")
        return rows.groupBy("key").agg(F.max("segment").alias("removed_at")) if rows is not None else None

    def live(self, name: str, key: str, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
        """The rows of a table whose key no later segment has taken out.

        of takes those that matter from all rows (with segment), before these
        meet the keys that are gone.
        """
        rows, gone = self.table(name), self.removals()
        if rows is not None and of is not None:
            rows = of(rows)
        if rows is None or gone is None:
            return rows.drop("segment") if rows is not None else None
        later = (F.col(key) == F.col("gone.key")) & (F.col("segment") < F.col("removed_at"))
        return rows.join(gone.alias("gone"), later, "left_anti").drop("segment")

    def compact(self, tables: dict[str, DataFrame], partitions: dict[str, str] | None = None, made_by: str | None = None) -> int | None:
        """Make the given tables, written from the live rows, the base on which later segments stand; older files go once it is committed."""
        old = self.commits()
        number = self.append(tables, base=True, partitions=partitions, made_by=made_by)
        for commit in old:
            fs, at = self._at(commit["folder"])
            fs.delete(at, True)
        return number
