"""Summaries in files by tenant and day: one copy each, wherever its day moves; deletion, retention and an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.storage import drop_stored, stored

INDEX = "tenant_id string, session_id string, day string"


class SummaryStore:
    """A folder of Parquet files, tenant_id=x/day=y, and beside it an index of where each session stands.

    A put rewrites the days that its sessions stand in or come to, and no
    others: first the days that get rows, then those that only lose them. A
    put that dies between leaves two copies, of which readers see the newer and
    which the next put or `rebuild` removes. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _all(self) -> DataFrame | None:
        fs, at = self._fs("rows")
        if not fs.exists(at) or not fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/tenant_id=*/day=*/*.parquet")):
            return None
        # as text: a folder's name would be read as a number or a date
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").withColumns({c: F.col(c).cast("string") for c in ("tenant_id", "day")})

    def rows(self) -> DataFrame | None:
        """Each session's newest summary; None before there are any."""
        every = self._all()
        if every is None:
            return None
        place = F.row_number().over(Window.partitionBy("tenant_id", "session_id").orderBy(F.desc("created_at"), F.desc("day")))
        return every.withColumn("_place", place).where("_place = 1").drop("_place")

    def index(self) -> DataFrame:
        """(tenant_id, session_id, day) of every summary; rebuilt when it isn't there."""
        fs, at = self._fs("index")
        if not fs.exists(at):
            self.rebuild()
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def _write_index(self, rows: DataFrame) -> None:
        held = stored(rows.select("tenant_id", "session_id", "day"), "index")
        held.write.mode("overwrite").parquet(f"{self.path}/index")
        drop_stored(held)

    def rebuild(self) -> int:
        """The index anew from the files, and copies under older days removed; how many summaries there are."""
        every = self._all()
        if every is None:
            self.spark.createDataFrame([], INDEX).write.mode("overwrite").parquet(f"{self.path}/index")
            return 0
        newest = stored(self.rows().select("tenant_id", "session_id", "day"), "newest")
        old = every.select("tenant_id", "session_id", "day").join(newest, ["tenant_id", "session_id", "day"], "left_anti")
        self._rewrite(old.select("tenant_id", "day").distinct(), lambda rows: rows.join(newest, ["tenant_id", "session_id", "day"], "left_semi"))
        self._write_index(newest)
        drop_stored(newest)
        return self.index().count()

    def _rewrite(self, days: DataFrame, change) -> None:
        """Replace the rows of some days (tenant_id, day) by change(rows); days that end up empty are removed."""
        days, every = stored(days, "days"), self._all()
        if every is not None and not days.isEmpty():
            kept = stored(change(every.join(days, ["tenant_id", "day"], "left_semi")), "kept")
            self._overwrite(kept)
            for r in days.join(kept, ["tenant_id", "day"], "left_anti").collect():  # days of one change
                self._drop(r["tenant_id"], r["day"])
            drop_stored(kept)
        drop_stored(days)

    def _overwrite(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "day").parquet(f"{self.path}/rows")

    def _drop(self, tenant: str, day: str) -> None:
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        fs, at = self._fs(f"rows/tenant_id={name(tenant)}/day={name(day)}")
        fs.delete(at, True)

    def put(self, summaries: DataFrame) -> None:
        """Write summaries (tenant_id, session_id, created_at, ...); those of the same tenant and session are replaced, on whatever day they stand."""
        fresh = stored(summaries.withColumn("tenant_id", F.col("tenant_id").cast("string")).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), "fresh")
        before = stored(self.index(), "before")
        keys = ["tenant_id", "session_id"]
        ids, into = fresh.select(*keys), fresh.select("tenant_id", "day").distinct()
        every = self._all()
        if every is None:
            self._overwrite(fresh)
        else:
            staying = every.join(into, ["tenant_id", "day"], "left_semi").join(ids, keys, "left_anti")
            whole = stored(staying.unionByName(fresh, allowMissingColumns=True), "whole")
            self._overwrite(whole)
            left = before.join(ids, keys, "left_semi").select("tenant_id", "day").distinct().join(into, ["tenant_id", "day"], "left_anti")
            self._rewrite(left, lambda rows: rows.join(ids, keys, "left_anti"))
            drop_stored(whole)
        self._write_index(before.join(ids, keys, "left_anti").unionByName(fresh.select("tenant_id", "session_id", "day")))
        drop_stored(fresh, before)

    def get(self, sessions: DataFrame) -> DataFrame | None:
        """The summaries of sessions (tenant_id, session_id); only the days that the index names are read."""
        every = self._all()
        if every is None:
            return None
        wanted = self.index().join(sessions, ["tenant_id", "session_id"], "left_semi")
        return every.join(wanted, ["tenant_id", "session_id", "day"], "left_semi")

    def delete(self, sessions: DataFrame) -> int:
        """Remove the summaries of sessions (tenant_id, session_id) from the files; how many there were."""
        keys = ["tenant_id", "session_id"]
        found = stored(self.index().join(sessions.select(*keys), keys, "left_semi"), "found")
        n = found.count()
        self._rewrite(found.select("tenant_id", "day").distinct(), lambda rows: rows.join(found, keys, "left_anti"))
        self._write_index(self.index().join(found, keys, "left_anti"))
        drop_stored(found)
        return n

    def purge(self, today: Column, keep_days: int) -> int:
        """Remove whole days before today less keep_days (0 keeps all); how many summaries went."""
        if keep_days <= 0 or self._all() is None:
            return 0
        old = stored(self.index().where(F.col("day") < F.date_format(F.date_sub(today, keep_days), "yyyy-MM-dd")), "old")
        for r in old.select("tenant_id", "day").distinct().collect():  # a row a tenant and day
            self._drop(r["tenant_id"], r["day"])
        n = old.count()
        self._write_index(self.index().join(old, ["tenant_id", "session_id"], "left_anti"))
        drop_stored(old)
        return n
