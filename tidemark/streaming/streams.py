"""Structured Streaming counterparts of the batch operators.

Sources here are file streams; ``format("kafka")`` takes their place where a
broker exists.  One query per checkpoint plays the role of a consumer group:
offsets live in the checkpoint, so a restart resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import framed, running, top_per_group
from tidemark.operators.timeseries import spikes
from tidemark.session import materialize, path_exists, scratch_path
from tidemark.sources.keyed_table import KeyedTable


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Stream of Parquet files from the earliest one on, ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        # a file source watches directories: watch the parent for this one name
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, *, starting: str = "earliest", **options) -> DataFrame:
    """Kafka source; needs the Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting} | options).load()


def land(stream: DataFrame, label: str, *, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over all available input into a Parquet table and read it back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    checkpoint = checkpoint or scratch_path(spark, f"{label}-checkpoint")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def as_messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value) messages with the whole row as JSON; works on batch and stream."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def replayable_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent batch writer: a replayed batch overwrites its own directory."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def merge_sink(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Apply each batch of change rows; a replayed batch is applied once."""
    return table.merge


def stream_statistics(topic: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Length, first and last entry per stream key of a landed topic."""
    return topic.groupBy(key).agg(F.count(F.lit(1)).alias("length"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def trim(topic: DataFrame, key: str, at: Sequence[str], newest: int) -> DataFrame:
    """Keep the newest N entries of each stream key."""
    return top_per_group(topic, [key], [F.desc(c) for c in at], newest)


def windowed(stream: DataFrame, ts: str, delay: str, width: str, slide: str | None, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Tumbling or sliding aggregate; a window is emitted once the watermark passes it."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = stream.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def session_windows(stream: DataFrame, ts: str, delay: str, gap: str, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    g = stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], gap_seconds: int, aggs: dict[str, Column]) -> DataFrame:
    """Batch sessions by gap: a row starts a session when its predecessor is too old."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    d = framed(df.withColumn("_us", micros), keys, order, lambda w: {"_prev": F.lag("_us").over(w)}, before=1)
    starts = F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= gap_seconds * 1_000_000), 1).otherwise(0)
    d = running(d.withColumn("_new", starts), keys, order, sums={"session": F.col("_new").cast("long")})
    return d.groupBy(*keys, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), *[c.alias(n) for n, c in aggs.items()])


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def route_late(path: str, ts: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """Split each batch into ``on_time`` and ``late`` rows by the largest time of the
    batches before it; the per-batch maximum is kept next to the output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, marks = batch.sparkSession, f"{path}/marks"
        seen = None
        if path_exists(spark, marks):
            seen = spark.read.option("recursiveFileLookup", True).parquet(marks).where(F.col("batch") < batch_id).agg(F.max("top")).first()[0]
        cutoff = F.lit(seen) - F.make_dt_interval(secs=F.lit(float(delay_seconds))) if seen is not None else F.lit(None)
        late = F.coalesce(F.col(ts) < cutoff, F.lit(False)) if seen is not None else F.lit(False)
        routed = batch.withColumn("route", F.when(late, "late").otherwise("on_time"))
        routed.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        batch.agg(F.max(ts).alias("top"), F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(f"{path}/marks/b{batch_id}")

    return write


def spike_sink(path: str, tails: KeyedTable, order: Sequence[str], value: str, carry: Sequence[str], confidence: float = 95, history: int = 50) -> Callable[[DataFrame, int], None]:
    """Flag spikes against the last ``history`` rows of a key, those of earlier batches included.

    ``tails`` (``spike_tails``) keeps these rows, one array a key; a batch reads and
    rewrites the buckets of its own keys.  Rows stand by batch, then by ``order``, and go
    through the batch operator ``spikes``, which splits a hot key: a micro-batch may bring
    any number of rows of one.  Writes the key, ``carry``, score, p_value and is_spike
    below ``path``, a folder per batch; a replayed batch
    overwrites its own from the same tails.  ``order`` must be unique within a key."""
    keys = tails.keys

    def write(batch: DataFrame, batch_id: int) -> None:
        changes = None
        if not tails.began(batch_id):
            fresh = batch.select(*keys, F.lit(history).alias("_at"), *order, F.col(value).cast("double").alias("_value"), F.struct(*carry).alias("_carry"))
            past = tails.lookup(batch.select(*keys)).select(*keys, F.posexplode("past").alias("_at", "_p"))
            past = past.select(*keys, "_at", *[F.col(f"_p.{c}").alias(c) for c in order], F.col("_p.value").alias("_value"))
            rows = materialize(past.unionByName(fresh, allowMissingColumns=True), "spike-rows")
            flagged = spikes(rows, keys, ["_at", *order], "_value", confidence, history).where(F.col("_at") == history)
            flagged.select(*keys, "_carry.*", "score", "p_value", "is_spike").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            last = top_per_group(rows, keys, [F.desc(c) for c in ("_at", *order)], history)
            entry = F.struct("_at", *order, F.col("_value").alias("value"))
            joined = last.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("past"))  # at most ``history`` a key
            changes = joined.select(*keys, F.transform("past", lambda e: e.dropFields("_at")).alias("past"), F.lit("I").alias("op"), F.lit(batch_id).alias("change_id"))
        tails.merge(changes, batch_id)

    return write


def spike_tails(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], buckets: int = 16) -> KeyedTable:
    """Empty table of the last rows of each key; take a bucket for each million keys or so."""
    entry = T.StructType([*[schema[c] for c in order], T.StructField("value", T.DoubleType())])
    table = KeyedTable(spark, path, keys)
    table.create(spark.createDataFrame([], T.StructType([*[schema[k] for k in keys], T.StructField("past", T.ArrayType(entry))])), buckets, feed=False)
    return table


def interval_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, delay: str, hours: int) -> DataFrame:
    """Right rows within ``hours`` after the left row; both sides carry watermarks so
    state is dropped once it cannot match any more."""
    l, r = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay).withColumnRenamed(on, "_on")
    within = F.expr(f"{right_ts} >= {left_ts} AND {right_ts} <= {left_ts} + INTERVAL {hours} HOURS")
    return l.join(r, (F.col(on) == F.col("_on")) & within).drop("_on")
