"""Window queries."""

from pyspark.sql import functions as F

from tidemark.operators.ordered import framed, range_framed
from tidemark.operators.windows import window_fn
from tidemark.plans.registry import query
from tidemark.session import Tables

BY = dict(partition_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"])
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)"
TIES = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST)"


def _chain(df, steps, **by):
    for fn, out, kw in steps:
        df = window_fn(df, fn, out, **{**by, **kw})
    return df


@query("window_ranking", "W1 W2 W3 W4", f"""
SELECT o_orderkey, row_number() {OVER} AS rn, rank() {TIES} AS rk, dense_rank() {TIES} AS drk FROM orders""")
def window_ranking(t: Tables):
    base = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    d = _chain(base, [("row_number", "rn", {}), ("rank", "rk", {}), ("dense_rank", "drk", {})], **BY)
    return d.select("o_orderkey", "rn", "rk", "drk")


@query("window_distribution", "W5 W11 W12", f"""
WITH p AS (SELECT o_orderkey, row_number() {OVER} AS pos, count(*) OVER (PARTITION BY o_custkey) AS n,
 ntile(4) {OVER} AS sql_tile, percent_rank() {TIES} AS pr, cume_dist() {TIES} AS cd FROM orders)
SELECT o_orderkey, least(floor((pos-1) / ceil(n/4.0)) + 1, 4)::BIGINT AS tile, sql_tile,
 round(CASE WHEN n > 1 THEN (pos-1)::DOUBLE/(n-1) ELSE 0 END, 6) AS pct_rank, round(pos::DOUBLE/n, 6) AS cume,
 round(pr, 6) AS sql_pct_rank, round(cd, 6) AS sql_cume FROM p""")
def window_distribution(t: Tables):
    base = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    d = _chain(base, [("ntile", "tile", {}), ("ntile", "sql_tile", {"sql_ties": True}), ("percent_rank", "pct_rank", {}),
                      ("cume_dist", "cume", {}), ("percent_rank", "sql_pct_rank", {"sql_ties": True}),
                      ("cume_dist", "sql_cume", {"sql_ties": True})], **BY)
    return d.select("o_orderkey", "tile", "sql_tile",
                    *[F.round(c, 6).alias(c) for c in ("pct_rank", "cume", "sql_pct_rank", "sql_cume")])


EV = dict(partition_by=["user_id"], order_by=["ts", "event_id"])
EVO = "PARTITION BY user_id ORDER BY ts, event_id"


@query("window_offsets", "W6 W7", f"""
SELECT event_id, lag(value, 1) OVER ({EVO}) AS prev1, lead(value, 2) OVER ({EVO}) AS next2,
 first_value(value) OVER ({EVO} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_v,
 last_value(value) OVER ({EVO} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_v FROM events""")
def window_offsets(t: Tables):
    base = t.events.select("event_id", "user_id", "ts", "value")
    d = _chain(base, [("lag", "prev1", {}), ("lead", "next2", {"offset": 2}), ("first_value", "first_v", {}),
                      ("last_value", "last_v", {})], value="value", **EV)
    return d.select("event_id", "prev1", "next2", "first_v", "last_v")


CENTS = "floor(value * 100 + 0.5)"


@query("window_running", "W8 W9 W10", f"""
SELECT event_id, sum({CENTS}) OVER ({EVO} ROWS UNBOUNDED PRECEDING) AS cum_sum,
 sum({CENTS}) OVER ({EVO} ROWS UNBOUNDED PRECEDING) / count(*) OVER ({EVO} ROWS UNBOUNDED PRECEDING) AS run_avg,
 sum({CENTS}) OVER ({EVO} ROWS 2 PRECEDING) / count(*) OVER ({EVO} ROWS 2 PRECEDING) AS mov_avg FROM events""")
def window_running(t: Tables):
    # whole cents keep the sums exact, whatever order the engines add them in
    base = t.events.select("event_id", "user_id", "ts", F.expr(CENTS).cast("double").alias("cents"))
    d = _chain(base, [("cumulative_sum", "cum_sum", {}), ("running_avg", "run_avg", {}), ("moving_avg", "mov_avg", {})],
               value="cents", **EV)
    return d.select("event_id", "cum_sum", "run_avg", "mov_avg")


@query("window_user_frames", "W13", f"""
SELECT event_id, max(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS local_max,
 count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS recent
FROM events WINDOW w AS ({EVO})""")
def window_user_frames(t: Tables):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    base = t.events.select("event_id", "user_id", "ts", "value", micros.alias("us"))
    d = framed(base, ["user_id"], ["ts", "event_id"], lambda w: {"local_max": F.max("value").over(w.rowsBetween(-3, 1))}, before=3, after=1)
    d = range_framed(d, ["user_id"], "us", 6 * 3600 * 1_000_000, lambda w: {"recent": F.count(F.lit(1)).over(w)})
    return d.select("event_id", "local_max", "recent")


@query("window_named_sql", "W13", f"""
SELECT event_id, max(value) OVER w AS top, count(*) OVER w AS n FROM events WINDOW w AS ({EVO} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)""")
def window_named_sql(t: Tables):
    # one named window shared by two functions
    base = t.events.select("event_id", "user_id", "ts", "value")

    def named(w):
        frame = w.rowsBetween(-3, 1)
        return {"top": F.max("value").over(frame), "n": F.count(F.lit(1)).over(frame)}

    return framed(base, ["user_id"], ["ts", "event_id"], named, before=3, after=1).select("event_id", "top", "n")


@query("window_filter", "W14", f"""
SELECT event_id, user_id, value FROM events QUALIFY value > avg(value) OVER ({EVO} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) * 3""")
def window_filter(t: Tables):
    base = t.events.select("event_id", "user_id", "ts", "value")
    d = framed(base, ["user_id"], ["ts", "event_id"], lambda w: {"_m": F.avg("value").over(w.rowsBetween(-5, -1))}, before=5)
    return d.where(F.col("value") > F.col("_m") * 3).select("event_id", "user_id", "value")
