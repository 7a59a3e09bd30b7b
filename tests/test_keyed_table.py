"""Merges and change feed of a keyed table against a dictionary, and what they read and write."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.sources.keyed_table import KeyedTable
from tidemark.streaming import streams as st

CHANGE = "change_id long, k long, v string, op string"


def made(spark, rows, buckets=8):
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"])
    table.create(spark.createDataFrame(rows, "k long, v string"), buckets)
    return table


def now(table):
    return {r.k: r.v for r in table.read().collect()}


def feed(table, *span):
    return sorted(((r.batch, r.op, r.k, r.v) for r in table.feed(*span).collect()), key=repr)


def files(spark, table):
    """Data files by bucket."""
    out = {}
    for f in spark.read.parquet(f"{table.root}/rows").inputFiles():
        out.setdefault(int(f.split("_bucket=")[1].split("/")[0]), set()).add(f)
    return out


def apply(state, batch, changes):
    """The expected state and feed of a batch, change by change."""
    before, last, out = dict(state), {}, []
    for ident, k, v, op in sorted(changes):
        last[k] = (v, op)
    for k, (v, op) in last.items():
        if op == "D":
            state.pop(k, None)
        elif op == "I" or k in state:
            state[k] = v
        if k in before and k not in state:
            out.append((batch, "D", k, before[k]))
        elif k in state and k not in before:
            out.append((batch, "I", k, v))
        elif k in state and (before[k] != state[k]):
            out.append((batch, "U", k, v))
    return out


def test_random_batches_with_null_keys_and_values(spark):
    rng = random.Random(5)
    keys = [None, *range(12)]
    state = {k: str(k) for k in keys[:9]}
    table, expected = made(spark, list(state.items()), 4), []
    for batch in range(4):
        changes = [(i, rng.choice(keys), rng.choice(["a", "b", None]), rng.choice("IUD")) for i in range(batch * 100, batch * 100 + 10)]
        expected += apply(state, batch, changes)
        table.merge(spark.createDataFrame(changes, CHANGE), batch)
        assert now(table) == state
    assert feed(table) == sorted(expected, key=repr)
    assert feed(table, 1, 2) == sorted([r for r in expected if 1 <= r[0] <= 2], key=repr)


def test_only_touched_buckets_are_read_and_written(spark):
    table = made(spark, [(i, "x") for i in range(200)])
    old = files(spark, table)
    bucket = {r.k: r._bucket for r in spark.read.parquet(f"{table.root}/rows").select("k", "_bucket").collect()}
    changes = spark.createDataFrame([(1, 5, "y", "U"), (2, 6, None, "D")], CHANGE)
    given = changes.select("k", "v", F.col("op").alias("_asked"), table._bucket(8))
    read = {int(f.split("_bucket=")[1].split("/")[0]) for f in _scanned(table._joined(given)) if "_bucket=" in f}
    table.merge(changes, 0)
    new = files(spark, table)
    touched = {bucket[5], bucket[6]}
    assert read == touched and 0 < len(touched) < 8
    assert {b for b in old if old[b] != new[b]} == touched
    assert all("/changes/" in f for f in table.feed().inputFiles()) and feed(table) == [(0, "D", 6, "x"), (0, "U", 5, "y")]
    # a range of batches is a range of folders
    table.merge(spark.createDataFrame([(3, 7, "z", "U")], CHANGE), 1)
    assert {f.split("_batch=")[1][0] for f in _scanned(table.feed(1))} == {"1"}


def _scanned(df):
    """Files that the scans of a plan read, behind their partition filters."""
    plan = df._jdf.queryExecution().sparkPlan()
    leaves, out = plan.collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("Scan parquet"):
            parts = leaf.inputRDD().partitions()
            for p in parts:
                out += [f.filePath().toString() for f in p.files()]
    return out


def test_a_bucket_may_lose_all_rows_and_come_back(spark):
    table = made(spark, [(1, "a"), (2, "b")], 1)
    table.merge(spark.createDataFrame([(1, 1, None, "D"), (2, 2, None, "D")], CHANGE), 0)
    assert now(table) == {}
    table.merge(spark.createDataFrame([(3, 2, "c", "U"), (4, 1, "d", "I")], CHANGE), 1)
    assert now(table) == {1: "d"}
    assert {(r.batch, r.op, r.outcome): r.n for r in table.outcomes().collect()} == {(0, "D", "applied"): 2, (1, "U", "failed"): 1, (1, "I", "applied"): 1}


def test_equal_values_and_empty_batches_change_nothing(spark):
    table = made(spark, [(1, "a"), (2, None)])
    table.merge(spark.createDataFrame([(1, 1, "a", "U"), (2, 2, None, "I")], CHANGE), 0)
    table.merge(spark.createDataFrame([], CHANGE), 1)
    assert now(table) == {1: "a", 2: None} and feed(table) == []


def test_a_table_may_start_empty(spark):
    table = made(spark, [])
    assert now(table) == {} and feed(table) == []
    table.merge(spark.createDataFrame([(1, None, "n", "I")], CHANGE), 0)
    assert now(table) == {None: "n"}


def test_a_batch_that_was_cut_short_goes_on_from_its_stored_result(spark, monkeypatch):
    table = made(spark, [(i, "x") for i in range(50)], 4)
    changes = spark.createDataFrame([(i, i, "y", "U" if i % 2 else "D") for i in range(20)], CHANGE)
    whole = KeyedTable._store

    def half(self, rows):
        whole(self, rows.where("_bucket < 2"))
        self._drop("rows/_bucket=3")  # as if the driver went between removal and rename
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_store", half)
    with pytest.raises(RuntimeError):
        table.merge(changes, 0)
    monkeypatch.setattr(KeyedTable, "_store", whole)
    table.merge(changes, 0)
    table.merge(changes, 0)  # a replay of an applied batch
    assert now(table) == {i: "y" if i < 20 else "x" for i in range(50) if i >= 20 or i % 2}
    assert len(feed(table)) == 20 and {op for _, op, _, _ in feed(table)} == {"U", "D"}


def test_create_rejects_repeated_keys_and_reserved_names(spark):
    with pytest.raises(Exception, match="several rows for one key"):
        made(spark, [(1, "a"), (1, "b")])
    with pytest.raises(ValueError, match="underscore"):
        KeyedTable(spark, scratch_path(spark, "keyed"), ["k"]).create(spark.createDataFrame([(1, 2)], "k long, _live long"))
    table = made(spark, [(1, "a")])
    with pytest.raises(ValueError, match="holds a table"):
        table.create(spark.createDataFrame([(1, "a")], "k long, v string"))


def test_the_stream_sink_goes_on_behind_a_restart(spark):
    table, source, checkpoint = made(spark, [(1, "a")]), scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    for i, row in enumerate([(1, 1, "b", "U"), (2, 2, "c", "I"), (3, 1, None, "D")]):
        spark.createDataFrame([row], CHANGE).write.mode("append").parquet(source)
        st.each_batch(st.read_stream(spark, source, spark.createDataFrame([], CHANGE).schema), st.merge_sink(table), checkpoint)
    assert now(table) == {2: "c"}
    assert feed(table) == [(0, "U", 1, "b"), (1, "I", 2, "c"), (2, "D", 1, "b")]
