"""Order statistics by selection against sorted lists."""

import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators import selection
from tidemark.operators.aggregates import Agg

SPECS = [Agg("x", "median", "med"), Agg("x", "percentile", "p90", 90), Agg("x", "iqr", "iqr"), Agg("x", "mad", "mad"), Agg("x", "mode", "mode"),
         Agg("x", "nearest_rank", "near", 0.9), Agg("x", "upper_median", "upper"), Agg("x", "sum", "total"), Agg("x", "count", "n")]


def quantile(v, p):
    at = p * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


def plain(values):
    v = sorted(x for x in values if x is not None)
    if not v:
        return dict.fromkeys(["med", "p90", "iqr", "mad", "mode", "near", "upper", "total", "n"])
    med = quantile(v, 0.5)
    return {"med": med, "p90": quantile(v, 0.9), "iqr": quantile(v, 0.75) - quantile(v, 0.25), "mad": quantile(sorted(abs(x - med) for x in v), 0.5),
            "mode": min(statistics.multimode(v)), "near": v[min(math.floor(0.9 * len(v)), len(v) - 1)], "upper": v[min(len(v) // 2, len(v) - 1)], "total": sum(v), "n": len(v)}


def groups(seed):
    r = random.Random(seed)
    shapes = {
        "wide": [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) for _ in range(90)],
        "near one": [1 + r.random() * 1e-9 for _ in range(90)],
        "few values": [float(r.randint(-2, 2)) for _ in range(90)],
        "one value": [7.5] * 60,
        "zeros": [0.0, -0.0, 5e-324, -5e-324] * 10,
        "prices": [round(r.uniform(900, 105_000), 2) for _ in range(150)],
        "nulls": [None] * 30,
        "two": [3.0, -4.0],
        "lonely": [2.0, None],
        None: [r.gauss(0, 1) for _ in range(70)],
    }
    return [(g, x) for g, v in shapes.items() for x in v]


@pytest.mark.parametrize("limit", [0, 50, 10_000])
def test_every_statistic_at_any_group_size(spark, limit):
    """Groups above the limit are selected from buckets, the others gathered."""
    data = groups(limit)
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r["g"]: r for r in ag.group_aggregate(df, ["g"], SPECS, limit=limit).collect()}
    assert set(got) == {g for g, _ in data}
    for g, r in got.items():
        for name, want in plain([x for k, x in data if k == g]).items():
            assert r[name] == (want if want is None else pytest.approx(want, rel=1e-12, abs=0)), (g, name)
    (whole,) = ag.aggregate(df, SPECS, limit=limit).collect()
    for name, want in plain([x for _, x in data]).items():
        assert whole[name] == pytest.approx(want, rel=1e-12), name


def test_buckets_too_large_for_a_task_are_ordered_in_chunks(spark, split):
    r = random.Random(3)
    data = [("dense", 1 + r.random() * 1e-3) for _ in range(400)] + [("wide", r.uniform(-1e6, 1e6)) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, x double").repartition(4)
    for row in ag.group_aggregate(df, ["g"], SPECS).collect():
        for name, want in plain([x for k, x in data if k == row["g"]]).items():
            assert row[name] == pytest.approx(want, rel=1e-9), name


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=2))
def test_bucket_rule_keeps_order(pair):
    def rule(x):
        if math.isinf(x):
            return math.copysign(32_766, x)
        size = math.floor((math.log2(abs(x)) + 1075) * selection.PER_DOUBLING) + 1 if x else 0
        return math.copysign(size, x) if x else 0

    low, high = sorted(pair)
    assert rule(low) <= rule(high) and abs(rule(high)) <= 32_766


def test_buckets_of_special_values(spark):
    values = [float("-inf"), -1.7e308, -1.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0000001, 1.7e308, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(selection.bucket(F.col("x"))).collect()]
    assert got == sorted(got) and got[0] == -32_766 and got[4] == 0 and got[-2:] == [32_766, 32_767] and got[6] < got[7] <= got[8]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=60))
def test_deviation_equals_sorted_list(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert ag.median_absolute_deviation(df, [], "x", "mad").first().mad == pytest.approx(plain(values)["mad"], rel=1e-9, abs=1e-300)
    assert ag.quantiles(df.limit(0), [], "x", [0.5]).collect()[0].q0 is None


def test_raw_rows_are_read_by_few_scans_and_joined_with_small_tables_only(spark, root):
    rows = spark.read.parquet(f"{root}/lineitem.parquet")
    chosen = selection.Selection(rows, ["l_returnflag"], "l_extendedprice")
    parts, _ = selection.interpolated("m", 0.5)
    plan = chosen.at(parts)._jdf.queryExecution().optimizedPlan().toString()
    # the second scan keeps the buckets of the wanted ranks alone
    assert "LeftSemi" in plan
