"""A table of rows by key that takes batches of changes and keeps what they changed.

Current rows lie in hash buckets of their key, each a partition of a Parquet folder.
A batch reads and rewrites the buckets that its keys fall into, by Spark's dynamic
partition overwrite, and stores the rows it changed in a plain table partitioned by
batch.  The change feed is a scan of that table; no versions are compared.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.cdc import latest_changes
from tidemark.operators.ordered import full_null_safe_join, null_safe_join
from tidemark.session import path_exists

BUCKET_ROWS = 1_000_000  # rows of a bucket, which one task writes
_LAYOUT = "buckets int, columns string, feed boolean"


class KeyedTable:
    """Rows below ``root``, one per key; null keys are equal to each other.

    Column names that start with an underscore are not allowed."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def create(self, df: DataFrame, buckets: int | None = None, *, feed: bool = True) -> None:
        """First rows.  Without ``feed`` no changes are kept.  ``buckets`` stays as it is for the life of the table: by default
        one for each million of these rows, so give it for a table that will grow.
        Several rows of a key are an error."""
        taken = [c for c in df.columns if c.startswith("_")]
        if taken:
            raise ValueError(f"column names with an underscore in front: {taken}")
        if self._exists("layout"):
            raise ValueError(f"{self.root} holds a table")
        buckets = buckets or df.count() // BUCKET_ROWS + 1
        values = [c for c in df.columns if c not in self.keys]
        one = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(True).alias("_in"), *values)).alias("_v"))
        one = one.select(*self.keys, F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.raise_error(F.lit("several rows for one key")).cast(one.schema["_v"].dataType)).alias("_v"))
        rows = one.select(*self.keys, *[f"_v.{c}" for c in values], F.col("_v._in").alias("_live"), self._bucket(buckets))
        self._store(rows.select(*df.columns, "_live", "_bucket"))
        # written last: a table without it was not finished
        layout = self.spark.createDataFrame([(buckets, df.schema.json(), feed)], _LAYOUT)
        layout.coalesce(1).write.mode("overwrite").json(f"{self.root}/layout")

    def read(self) -> DataFrame:
        return self._rows().where("_live").drop("_live", "_bucket")

    def merge(self, changes: DataFrame, batch: int, *, op: str = "op", change_id: str = "change_id") -> None:
        """Apply the last change of each key: I inserts or replaces, U replaces, D deletes.

        U and D of a missing key fail and change nothing.  A batch that was applied is
        left out when it comes again; one that was cut short goes on from its stored
        result, so a lost driver or executor leaves no bucket between two states."""
        if self._exists(f"done/batch={batch}"):
            return
        pending = f"{self.root}/pending/batch={batch}"
        if not self._exists(f"pending/batch={batch}/_SUCCESS"):
            # the last change of each key, stored: a batch is read once, however often it could change
            given, fields = f"{self.root}/pending/given={batch}", self._schema()
            last = latest_changes(changes.select(*fields.names, op, change_id), self.keys, change_id)
            last.select(*[F.col(f.name).cast(f.dataType) for f in fields], F.col(op).alias("_asked"), self._bucket(self._buckets())).write.mode("overwrite").parquet(given)
            self._joined(self.spark.read.parquet(given)).write.mode("overwrite").parquet(pending)
        step = self.spark.read.parquet(pending)
        if self._layout().feed:
            seen = step.where("_op is not null").select("_op", "_outcome", *self.keys, F.coalesce("_new", "_old").alias("_v"))
            seen.write.mode("overwrite").parquet(f"{self.root}/changes/_batch={batch}")
        names = self._schema().names
        live = [F.col(c) if c in self.keys else F.col(f"_new.{c}").alias(c) for c in names]
        # a row that is not live keeps a bucket whose rows all went, so that it is overwritten too
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema()]
        mark = step.select("_bucket").distinct().select(*nothing, F.lit(False).alias("_live"), "_bucket")
        self._store(step.where("_new is not null").select(*live, F.lit(True).alias("_live"), "_bucket").unionByName(mark))
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/done/batch={batch}")
        self._drop("pending")

    def began(self, batch: int) -> bool:
        """Is the result of a batch stored, so that ``merge`` no longer asks for its changes?"""
        return self._exists(f"done/batch={batch}") or self._exists(f"pending/batch={batch}/_SUCCESS")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of the keys in ``wanted``, read from their buckets alone."""
        marked = wanted.select(*self.keys, self._bucket(self._buckets()))
        touched = [r[0] for r in marked.select("_bucket").distinct().collect()]  # at most one row per bucket
        rows = self._rows().where("_live").where(F.col("_bucket").isin(touched)).drop("_live", "_bucket")
        return null_safe_join(rows, marked.select(*self.keys).distinct(), self.keys, "left_semi")

    def feed(self, start: int = 0, end: int | None = None) -> DataFrame:
        """batch, op, keys and values (old ones of deleted rows) of the rows that batches
        from ``start`` to ``end`` inserted (I), changed (U) or deleted (D).  A key has one
        row a batch; a change to equal values is none."""
        d = self._changes().where("_outcome = 'applied'").where(F.col("_batch") >= start)
        if end is not None:
            d = d.where(F.col("_batch") <= end)
        return d.select(F.col("_batch").alias("batch"), F.col("_op").alias("op"), *[c if c in self.keys else f"_v.{c}" for c in self._schema().names])

    def outcomes(self) -> DataFrame:
        """batch, op, outcome (applied, equal, failed) and number of changed keys."""
        return self._changes().groupBy(F.col("_batch").alias("batch"), F.col("_op").alias("op"), F.col("_outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))

    def _joined(self, given: DataFrame) -> DataFrame:
        """Rows of the touched buckets before (``_old``) and after (``_new``) the changes;
        ``_op`` is null where a row has none."""
        values = [c for c in self._schema().names if c not in self.keys]
        touched = [r[0] for r in given.select("_bucket").distinct().collect()]  # at most one row per bucket
        old = self._rows().where("_live").where(F.col("_bucket").isin(touched))
        o = old.select(*self.keys, F.struct(F.lit(True).alias("_in"), *values).alias("_old"))
        n = given.select(*self.keys, "_asked", F.struct(F.lit(True).alias("_in"), *values).alias("_given"))
        known, asked = F.col("_old").isNotNull(), F.col("_asked")
        failed = (asked != "I") & ~known
        equal = known & (asked != "D") & F.col("_given").eqNullSafe(F.col("_old"))
        d = full_null_safe_join(o, n, self.keys)
        return d.select(
            *self.keys, "_old", F.when(asked.isNull() | failed, F.col("_old")).when(asked != "D", F.col("_given")).alias("_new"),
            F.when(failed, asked).when(asked == "D", "D").when(asked.isNotNull(), F.when(known, "U").otherwise("I")).alias("_op"),
            F.when(failed, "failed").when(equal, "equal").when(asked.isNotNull(), "applied").alias("_outcome"), self._bucket(self._buckets()))

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int").alias("_bucket")

    def _store(self, rows: DataFrame) -> None:
        """Replace the buckets that ``rows`` has, one task and one file each."""
        rows.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/rows")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType(self._schema().fields).add("_live", T.BooleanType()).add("_bucket", T.IntegerType())).parquet(f"{self.root}/rows")

    def _changes(self) -> DataFrame:
        fields = self._schema()
        v = T.StructType([T.StructField("_in", T.BooleanType()), *[f for f in fields if f.name not in self.keys]])
        schema = T.StructType([T.StructField("_op", T.StringType()), T.StructField("_outcome", T.StringType()), *[fields[k] for k in self.keys], T.StructField("_v", v)]).add("_batch", T.LongType())
        if not self._exists("changes"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/changes")

    def _layout(self):
        if not hasattr(self, "_known"):
            self._known = self.spark.read.schema(_LAYOUT).json(f"{self.root}/layout").first()
        return self._known

    def _buckets(self) -> int:
        return self._layout().buckets

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._layout().columns))

    def _exists(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.root}/{name}")

    def _drop(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
