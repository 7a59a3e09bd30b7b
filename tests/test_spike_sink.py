"""Spikes over micro-batches against the batch operator over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.timeseries import spikes
from tidemark.session import scratch_path
from tidemark.sources.keyed_table import KeyedTable
from tidemark.streaming import streams as st

ROWS = "k string, at long, id long, v double"
ORDER = ["at", "id"]


def rows_of(seed, n, hot=0.6):
    """One key has most rows, one is null; values are mostly near 10, some are far, some null."""
    rng, out = random.Random(seed), []
    for i in range(n):
        k = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        v = rng.choice([None, 500.0]) if rng.random() < 0.05 else rng.gauss(10, 1)
        out.append((k, i // 2, i, v))
    return out


def setup(spark):
    schema = spark.createDataFrame([], ROWS).schema
    tails = st.spike_tails(spark, scratch_path(spark, "tails"), schema, ["k"], ORDER, 4)
    out = scratch_path(spark, "flags")
    return schema, tails, out, st.spike_sink(out, tails, ORDER, "v", ["id"], history=8)


def flags(df):
    return {r.id: (r.is_spike, None if r.score is None else round(r.score, 6)) for r in df.collect()}


def test_micro_batches_with_restarts_equal_one_batch(spark):
    schema, tails, out, sink = setup(spark)
    rows, source, checkpoint = rows_of(1, 160), scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    for lo, hi in [(0, 3), (3, 90), (90, 160)]:
        part = rows[lo:hi]
        random.Random(lo).shuffle(part)  # rows of a micro-batch come in any order
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(source)
        st.each_batch(st.read_stream(spark, source, schema), sink, checkpoint)
    want = flags(spikes(spark.createDataFrame(rows, schema), ["k"], ORDER, "v", history=8))
    assert flags(spark.read.parquet(out)) == want
    assert sum(bool(s) for s, _ in want.values()) > 2
    kept = {r.k: r.n for r in tails.read().select("k", F.size("past").alias("n")).collect()}
    assert kept["hot"] == 8 and set(kept) == {"hot", "a", "b", None}


def test_a_hot_key_is_split(spark, split):
    schema, _, out, sink = setup(spark)
    rows = rows_of(2, 150, hot=1.0)
    sink(spark.createDataFrame(rows[:100], schema), 0)
    sink(spark.createDataFrame(rows[100:], schema), 1)
    assert flags(spark.read.parquet(out)) == flags(spikes(spark.createDataFrame(rows, schema), ["k"], ORDER, "v", history=8))


def test_a_batch_that_comes_again_gives_the_same_flags(spark, monkeypatch):
    schema, _, out, sink = setup(spark)
    rows = rows_of(3, 60)
    sink(spark.createDataFrame(rows[:30], schema), 0)
    whole = KeyedTable._store

    def lost(self, _):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_store", lost)
    with pytest.raises(RuntimeError):
        sink(spark.createDataFrame(rows[30:], schema), 1)
    monkeypatch.setattr(KeyedTable, "_store", whole)
    for _ in range(2):
        sink(spark.createDataFrame(rows[30:], schema), 1)
    sink(spark.createDataFrame([], schema), 2)
    assert flags(spark.read.parquet(out)) == flags(spikes(spark.createDataFrame(rows, schema), ["k"], ORDER, "v", history=8))
