"""Aggregation queries."""

from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators.aggregates import Agg
from tidemark.operators.ordered import running
from tidemark.plans.registry import query
from tidemark.session import materialize

P = "l_extendedprice"

STATS = [
    Agg(P, "count", "n"), Agg(P, "sum", "revenue"), Agg(P, "average", "mean"), Agg(P, "min", "lo"),
    Agg(P, "max", "hi"), Agg(P, "median", "med"), Agg(P, "mode", "mode_value"), Agg(P, "variance", "var"),
    Agg(P, "stddev", "sd"), Agg(P, "range", "spread"), Agg(P, "percentile", "p90", 90),
    Agg(P, "quartile", "q1", 1), Agg(P, "iqr", "iqr"), Agg(P, "mad", "mad"), Agg(P, "skewness", "skew"),
    Agg(P, "kurtosis", "kurt"), Agg(P, "geometric_mean", "gmean"), Agg(P, "harmonic_mean", "hmean"),
    Agg(P, "rms", "rms"), Agg(P, "cv", "cv"), Agg(P, "z_score", "z", 20000), Agg(P, "percentile_rank", "prank", 20000),
]
# decimals kept per statistic when results are compared
DIGITS = dict(n=0, revenue=2, mean=4, lo=2, hi=2, med=4, mode_value=2, var=1, sd=4, spread=2, p90=4, q1=4, iqr=4,
              mad=4, skew=6, kurt=6, gmean=4, hmean=4, rms=4, cv=6, z=6, prank=6)


def _stats_sql(key: str | None) -> str:
    k = f"{key}," if key else ""
    by = f"GROUP BY {key}" if key else ""
    part = f"PARTITION BY {key}" if key else ""
    outs = ", ".join(
        f"CAST({c} AS BIGINT) AS n" if c == "n" else f"round({c}, {d}) AS {c}" for c, d in DIGITS.items()
    )
    return f"""
WITH b AS (SELECT {k} l_extendedprice AS x, avg(l_extendedprice) OVER ({part}) AS m,
       stddev_pop(l_extendedprice) OVER ({part}) AS s, median(l_extendedprice) OVER ({part}) AS d FROM lineitem),
md AS (SELECT {k} x, count(*) AS c FROM b GROUP BY {k} x),
mo AS (SELECT {k} arg_min(x, (-c, x)) AS mode_value FROM md {by}),
a AS (SELECT {k} count(x)::DOUBLE AS n, sum(CAST(x AS DECIMAL(18,2)))::DOUBLE AS revenue, avg(x) AS mean, min(x) AS lo, max(x) AS hi,
 median(x) AS med, var_pop(x) AS var, stddev_pop(x) AS sd, max(x)-min(x) AS spread, quantile_cont(x, 0.9) AS p90,
 quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, median(abs(x-d)) AS mad,
 sum(power((x-m)/s, 3)) AS z3, sum(power((x-m)/s, 4)) AS z4, exp(avg(ln(x))) AS gmean, count(x)/sum(1/x) AS hmean,
 sqrt(avg(x*x)) AS rms, stddev_pop(x)/avg(x)*100 AS cv, (20000-avg(x))/stddev_pop(x) AS z,
 (count(*) FILTER (x < 20000) + 0.5 * count(*) FILTER (x = 20000)) / count(*) * 100 AS prank
 FROM b {by}),
f AS (SELECT a.*, mo.mode_value, n/((n-1)*(n-2))*z3 AS skew,
 n*(n+1)/((n-1)*(n-2)*(n-3))*z4 - 3*(n-1)*(n-1)/((n-2)*(n-3)) AS kurt FROM a JOIN mo ON {f'a.{key} = mo.{key}' if key else 'true'})
SELECT {k} {outs}"""


def _rounded(df, keys):
    return df.select(*keys, *[F.round(c, d).alias(c) if c != "n" else F.col(c) for c, d in DIGITS.items()])


@query("flag_statistics_ranked", "S1 P5 A2 A3 A4 A5 A6 A7 A8 A9 A10 A11 A12 A13 A14 A15 A16 A17 A18 A19 A20 W3",
       _stats_sql("l_returnflag") + ", CAST(rank() OVER (ORDER BY revenue DESC) AS BIGINT) AS revenue_rank FROM f")
def flag_statistics_ranked(t):
    # one row per flag: stored once so that ranking does not repeat the aggregation
    stats = materialize(ag.group_aggregate(t.lineitem, ["l_returnflag"], STATS), "flag-statistics")
    out = _rounded(stats, ["l_returnflag"])
    return running(out, [], [F.col("revenue").desc(), F.col("l_returnflag")], position="revenue_rank")


@query("global_statistics", "A1", _stats_sql(None) + " FROM f")
def global_statistics(t):
    return _rounded(ag.aggregate(t.lineitem, STATS), [])


@query("supplier_order_statistics", "A5 A9 A12 A21 A22 A23", """
WITH b AS (SELECT l_suppkey, l_quantity AS x, l_partkey, median(l_quantity) OVER (PARTITION BY l_suppkey) AS d,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, median(x) AS med, round(quantile_cont(x, 0.95), 4) AS p95, median(abs(x-d)) AS mad,
  max(x) FILTER (i = least(floor(0.9*n), n-1)) AS nearest90, max(x) FILTER (i = floor(0.5*n)) AS upper_med FROM b GROUP BY 1""")
def supplier_order_statistics(t):
    q = "l_quantity"
    specs = [Agg("l_partkey", "distinct_count", "parts"), Agg(q, "median", "med"), Agg(q, "percentile", "p95", 95),
             Agg(q, "mad", "mad"), Agg(q, "nearest_rank", "nearest90", 0.9), Agg(q, "upper_median", "upper_med")]
    return ag.group_aggregate(t.lineitem, ["l_suppkey"], specs).withColumn("p95", F.round("p95", 4))


@query("totals_and_groups", "A24", """
SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) > 0 AS is_total, count(*) AS n, sum(l_quantity) AS qty
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag, l_linestatus))""")
def totals_and_groups(t):
    return ag.aggregate_with_totals(t.lineitem, ["l_returnflag", "l_linestatus"],
                                    {"n": F.count(F.lit(1)), "qty": F.sum("l_quantity")})


_CUBE_COLS = """CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid, count(*) AS n,
 round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM orders"""


def _cube_aggs():
    return [F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")]


@query("orders_cube", "A25", f"SELECT o_orderstatus, o_orderpriority, {_CUBE_COLS} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def orders_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(*_cube_aggs())


@query("orders_rollup", "A25", f"SELECT o_orderstatus, o_orderpriority, {_CUBE_COLS} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def orders_rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(*_cube_aggs())


@query("orders_grouping_sets", "A25",
       f"SELECT o_orderstatus, o_orderpriority, {_CUBE_COLS} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def orders_grouping_sets(t):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupingSets([[s], [p]], s, p).agg(*_cube_aggs())


@query("row_and_distinct_counts", "A26", """
SELECT (SELECT count(*) FROM lineitem) AS n_rows,
 (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS distinct_rows""")
def row_and_distinct_counts(t):
    # one pass: duplicates are combined before they are counted
    per_row = t.lineitem.groupBy(*t.lineitem.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows"))


@query("document_group_stage", "A27", """
SELECT c_mktsegment AS _id, count(*) AS n, round(avg(c_acctbal), 4) AS avg_bal, min(c_acctbal) AS lo, max(c_acctbal) AS hi,
 round(sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM customer GROUP BY 1""")
def document_group_stage(t):
    out = ag.document_group(t.customer, "c_mktsegment", {
        "n": ("$count", "*"), "avg_bal": ("$avg", "c_acctbal"), "lo": ("$min", "c_acctbal"),
        "hi": ("$max", "c_acctbal"), "total": ("$sum", "c_acctbal")})
    return out.withColumns({"avg_bal": F.round("avg_bal", 4), "total": F.round("total", 2)})


@query("order_value_buckets", "A28", """
SELECT CASE WHEN o_totalprice >= 1000 AND o_totalprice < 50000 THEN 1000.0 WHEN o_totalprice >= 50000 AND o_totalprice < 150000 THEN 50000.0
 WHEN o_totalprice >= 150000 AND o_totalprice < 300000 THEN 150000.0 END::DOUBLE AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def order_value_buckets(t):
    return ag.bucket_counts(t.orders, "o_totalprice", [1000, 50000, 150000, 300000])


@query("collection_size", "A29", """
SELECT count(*) AS documents, round(avg(strlen('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '","p_type":"' || p_type ||
 '","p_size":' || p_size || ',"p_retailprice":' || p_retailprice || '}')), 6) AS avg_size FROM part""")
def collection_size(t):
    return ag.collection_stats(t.part).withColumn("avg_size", F.round("avg_size", 6))


@query("event_facets", "A30", """
SELECT 'by_type' AS facet, event_type AS label, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'by_day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'large', CASE WHEN value > 100 THEN 'yes' ELSE 'no' END, count(*) FROM events GROUP BY 2""")
def event_facets(t):
    # each branch scans only its own column, so no input cache is needed
    def by(c):
        return t.events.groupBy(c.alias("label")).agg(F.count(F.lit(1)).alias("n"))

    return ag.facets({"by_type": by(F.col("event_type")), "by_day": by(F.date_format("ts", "yyyy-MM-dd")),
                      "large": by(F.when(F.col("value") > 100, "yes").otherwise("no"))})


@query("event_metric_histogram", "A31", """
WITH b AS (SELECT unnest([10.0, 50.0, 100.0, 250.0, NULL])::DOUBLE AS le),
g AS (SELECT event_type, count(value) AS observations, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM events GROUP BY 1)
SELECT event_type, observations, total, le, (SELECT count(*) FROM events e WHERE e.event_type = g.event_type AND (le IS NULL OR e.value <= le)) AS n
FROM g, b""")
def event_metric_histogram(t):
    out = ag.metric_histogram(t.events, ["event_type"], "value", [10, 50, 100, 250])
    return out.withColumn("total", F.round("total", 2))


@query("event_metric_snapshot", "A31", """
SELECT event_type, count(*) AS counter, arg_max(value, (ts, event_id)) AS gauge, round(median(value), 4) AS p50,
 round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1""")
def event_metric_snapshot(t):
    # counter, gauge (latest set value) and summary quantiles per metric name
    latest = t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))
    q = ag.quantiles(t.events, ["event_type"], "value", [0.5, 0.99])
    return latest.join(q.select("event_type", F.round("q0", 4).alias("p50"), F.round("q1", 4).alias("p99")), "event_type")
