"""Versioned snapshots on plain Parquet.

Layout: ``data/<uuid>`` holds one immutable data set per write, ``manifest/<n>.json``
one row per commit.  Data is written first.  The manifest file comes last and is
created without overwriting, an atomic step of the file system: of two writers
one gets the number and the other takes the next.  A clone pins the data it
points at in the source's manifest, so the source does not delete it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cdc import diff
from tidemark.session import path_exists

_MANIFEST = "version long, committed_at timestamp, operation string, path string, rows long, comment string, removed array<long>, pinned string"
_TRIES = 100


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        # a file that a writer has created and not yet filled has no row
        return self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest").where("version is not null")

    def history(self) -> DataFrame:
        """Live versions, newest first."""
        log = self.log()
        removed = log.select(F.explode("removed").alias("version"))
        live = log.where("path is not null").join(removed, "version", "left_anti")
        return live.drop("removed", "pinned").orderBy(F.desc("version"))

    def _next(self) -> int:
        if not path_exists(self.spark, f"{self.root}/manifest"):
            return 1
        return (self.log().agg(F.max("version")).first()[0] or 0) + 1

    def _commit(self, operation: str, path: str | None, rows: int | None, comment: str = "", removed: Sequence[int] = (), pinned: str | None = None) -> int:
        version = self._next()
        for _ in range(_TRIES):
            row = {"version": version, "committed_at": datetime.now(timezone.utc).isoformat(), "operation": operation, "path": path, "rows": rows, "comment": comment, "removed": list(removed), "pinned": pinned}
            if self._create(f"{self.root}/manifest/{version:020d}.json", json.dumps(row) + "\n"):
                return version
            version = max(version, self._next() - 1) + 1  # another writer has this number
        raise RuntimeError(f"{_TRIES} commits were taken by other writers")

    def _create(self, name: str, text: str) -> bool:
        """Create a file with this content; False if there is one of that name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def write(self, df: DataFrame, operation: str = "write", comment: str = "") -> int:
        from pyspark.sql import Observation

        path, seen = f"{self.root}/data/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        return self._commit(operation, path, seen.get["rows"], comment)

    def _entry(self, version: int | None = None, as_of: datetime | None = None):
        h = self.history()
        if version is not None:
            h = h.where(F.col("version") == version)
        if as_of is not None:
            h = h.where(F.col("committed_at") <= F.lit(as_of))
        entry = h.limit(1).first()
        if entry is None:
            raise ValueError("no such version")
        return entry

    def read(self, version: int | None = None, as_of: datetime | None = None) -> DataFrame:
        return self.spark.read.parquet(self._entry(version, as_of).path)

    def restore(self, version: int) -> int:
        """New version that points at the data of an old one."""
        e = self._entry(version)
        return self._commit("restore", e.path, e.rows, f"restored {version}")

    def delete(self, *versions: int) -> int:
        return self._commit("delete", None, None, removed=versions)

    def prune(self, keep: int = 10) -> list[int]:
        """Keep the newest ``keep`` versions."""
        old = [r.version for r in self.history().offset(keep).collect()]  # manifest rows only
        if old:
            self.delete(*old)
        return old

    def vacuum(self, retention_hours: float = 168, now: datetime | None = None) -> list[str]:
        """Delete data no live version uses and whose commits are older than the retention."""
        now = now or datetime.now(timezone.utc)
        pinned = self.log().where("pinned is not null").select(F.col("pinned").alias("path"))
        log, live = self.log().where("path is not null"), self.history().select("path").union(pinned)
        old = log.where(F.col("committed_at") < F.lit(now) - F.make_dt_interval(secs=F.lit(retention_hours * 3600.0)))
        dead = [r.path for r in old.select("path").distinct().join(live, "path", "left_anti").collect() if r.path.startswith(self.root)]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for p in dead:
            path = hadoop(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return dead

    def clone_to(self, root: str) -> "SnapshotTable":
        """New table whose first version points at this one's data; nothing is copied.

        The data is pinned here first, and stays until this table's folder goes."""
        e, other = self._entry(), SnapshotTable(self.spark, root)
        self._commit("pin", None, None, f"cloned to {root}", pinned=e.path)
        other._commit("clone", e.path, e.rows, f"clone of {self.root}@{e.version}")
        return other

    def optimize(self, cluster_by: Sequence[str], files: int | None = None) -> int:
        """Compact and cluster: range-partitioned rewrite as a new version."""
        df = self.read()
        df = df.repartitionByRange(files, *cluster_by) if files else df.repartitionByRange(*cluster_by)
        return self.write(df.sortWithinPartitions(*cluster_by), "optimize")

    def change_feed(self, keys: Sequence[str], start: int, end: int | None = None) -> DataFrame:
        """I / U / D rows between consecutive live versions after ``start``."""
        versions = sorted(r.version for r in self.history().where(F.col("version") >= start).collect())  # manifest rows only
        versions = [v for v in versions if end is None or v <= end]
        out = None
        for a, b in zip(versions, versions[1:]):
            d = diff(self.read(a), self.read(b), keys).withColumn("version", F.lit(b))
            out = d if out is None else out.unionByName(d)
        if out is None:
            raise ValueError("need two versions for a change feed")
        return out
