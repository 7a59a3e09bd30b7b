"""Projection, predicate, sampling, dedup, sort and set queries."""

from pyspark.sql import functions as F

from tidemark.functions import privacy
from tidemark.operators import filters as fl
from tidemark.operators import sampling as sm
from tidemark.operators import setops as so
from tidemark.operators.ordered import top_per_group
from tidemark.operators.windows import window_fn
from tidemark.plans.registry import query
from tidemark.session import Tables

DAY = "yyyy-MM-dd"


@query("columns_include_exclude", "P1 P2", "SELECT o_orderkey, o_totalprice FROM orders")
def columns_include_exclude(t: Tables):
    kept = fl.select_columns(t.orders, "include", ["O_TOTALPRICE", "o_orderkey", "o_orderstatus"])
    return fl.select_columns(kept, "exclude", ["O_ORDERSTATUS"])


@query("columns_by_wildcard", "P3 X5", "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE regexp_matches(lower(p_brand), '^brand.[1-3]$')")
def columns_by_wildcard(t: Tables):
    d = t.part.where(fl.wildcard_match(F.col("p_brand"), "BRAND?[1-3]") | F.col("p_brand").rlike("(?i)^brand#[1-3]$"))
    return fl.select_columns(d, "pattern", patterns=["P_PARTK*", "*brand", "p_?etailprice"])


@query("columns_through_alias", "P4", "SELECT c_custkey, c_name FROM customer")
def columns_through_alias(t: Tables):
    return fl.select_aliased(t.customer, "src", ["c_custkey", "c_name"])


@query("predicate_tree", "P5 P6 P7 P8 P9 P10", """
SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice >= 1000 AND o_totalprice < 400000 AND o_orderpriority LIKE '%-%' AND o_orderpriority <> '5-LOW'
 AND o_orderkey IS NOT NULL) AND (o_orderstatus IN ('F','O') OR o_totalprice BETWEEN 150000 AND 200000 OR o_orderdate IS NULL)""")
def predicate_tree(t: Tables):
    spec = {"and": [
        {"and": [("o_totalprice", ">=", 1000), ("o_totalprice", "<", 400000), ("o_orderpriority", "like", "%-%"),
                 ("o_orderpriority", "!=", "5-LOW"), ("o_orderkey", "is_not_null")]},
        {"or": [("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", "between", (150000, 200000)),
                ("o_orderdate", "is_null")]}]}
    return t.orders.where(fl.predicate(spec)).select("o_orderkey", "o_totalprice")


@query("predicate_text", "P12", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
def predicate_text(t: Tables):
    return t.customer.where("c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'").select("c_custkey", "c_acctbal")


@query("column_security", "P13 R5", """
SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '***' ELSE left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS c_name,
 '***' AS c_mktsegment, c_nationkey FROM customer""")
def column_security(t: Tables):
    return fl.column_security(t.customer, ["analyst"], {"c_acctbal": ["finance"], "c_name": ["analyst", "finance"]},
                              {"c_name": privacy.policy_partial, "c_mktsegment": privacy.policy_full})


@query("transform_steps", "P14 X1 X2 X3", """
SELECT c_custkey, left(c_name, 3) || repeat('*', length(c_name) - 3) AS c_name, upper(sha256(c_mktsegment)) AS c_mktsegment, 2 AS applied FROM customer""")
def transform_steps(t: Tables):
    steps = [("c_name", lambda c: privacy.mask_keep_first(c, 3)), ("no_such_column", F.upper), ("c_mktsegment", privacy.sha256_hex)]
    out, applied = fl.apply_transforms(t.customer.select("c_custkey", "c_name", "c_mktsegment"), steps)
    return out.withColumn("applied", F.lit(applied))


@query("series_range_filter", "P15", """
SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'purchase'""")
def series_range_filter(t: Tables):
    d = fl.time_range(t.events, "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"), event_type="purchase")
    return d.select("event_id", "user_id", "value")


@query("audit_log_query", "P16", """
SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' AND user_id = 7""")
def audit_log_query(t: Tables):
    d = fl.time_range(t.events, "ts", F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"),
                      inclusive=True, user_id=7)
    return d.select("event_id", "event_type")


@query("sample_random", "SM1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def sample_random(t: Tables):
    d = t.orders.select("o_orderkey", "o_totalprice")
    return sm.sample(d, "random", 500, key=["o_orderkey"], max_full_rows=1000)


@query("sample_recent", "SM2", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 400")
def sample_recent(t: Tables):
    return sm.sample(t.orders, "recent", 400, key=["o_orderkey"], date_col="o_orderdate", max_full_rows=1000).select("o_orderkey")


@query("sample_recent_detected", "SM3", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 300")
def sample_recent_detected(t: Tables):
    return sm.sample(t.events, "recent", 300, key=["event_id"], max_full_rows=500).select("event_id")


@query("sample_head", "SM4", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def sample_head(t: Tables):
    return sm.sample(t.orders, "head", 50, key=["o_orderkey"], max_full_rows=1000).select("o_orderkey", "o_custkey")


@query("sample_tail", "SM5", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def sample_tail(t: Tables):
    return sm.sample(t.orders, "tail", 50, key=["o_orderkey"], max_full_rows=1000).select("o_orderkey", "o_custkey")


@query("sample_stratified", "SM6", """
WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn,
 count(*) OVER (PARTITION BY o_orderpriority) AS c, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_orderpriority FROM r WHERE rn <= ceil(600.0 * c / n)""")
def sample_stratified(t: Tables):
    d = t.orders.select("o_orderkey", "o_orderpriority")
    return sm.sample(d, "stratified", 600, key=["o_orderkey"], stratify_col="o_orderpriority", max_full_rows=1000)


@query("sample_query", "SM7", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 100")
def sample_query(t: Tables):
    return sm.sample(t.orders.select("o_orderkey", "o_totalprice"), "query", 100, key=["o_orderkey"], where="o_totalprice > 200000")


@query("sample_full", "SM8", "SELECT * FROM supplier")
def sample_full(t: Tables):
    return sm.sample(t.supplier, "full", 10, key=["s_suppkey"])


@query("sample_summary", "SM9", "SELECT 'orders' AS table_name, least(700, count(*)) AS sampled_rows, count(*) AS source_rows FROM orders")
def sample_summary(t: Tables):
    d = t.orders.select("o_orderkey")
    return sm.sample_summary("orders", d, sm.sample(d, "random", 700, key=["o_orderkey"], max_full_rows=0))


DEDUP = "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {}) AS rn FROM orders) WHERE rn = 1"


@query("dedup_first", "D1 D2", DEDUP.format("o_orderdate, o_orderkey"))
def dedup_first(t: Tables):
    return sm.dedup(t.orders, ["o_custkey"], order_by=["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("dedup_last", "D2", DEDUP.format("o_orderdate DESC, o_orderkey DESC"))
def dedup_last(t: Tables):
    return sm.dedup(t.orders, ["o_custkey"], "last", order_by=["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("dedup_by_ranking", "D3", DEDUP.format("o_totalprice DESC, o_orderkey"))
def dedup_by_ranking(t: Tables):
    return sm.dedup(t.orders, ["o_custkey"], "ranking", ranking="o_totalprice", order_by=["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("dedup_counts", "D4", """
SELECT count(*) AS original, count(DISTINCT (l_orderkey, l_linenumber)) AS final, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed FROM lineitem""")
def dedup_counts(t: Tables):
    return sm.dedup_counts(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("sort_multi_key", "O1", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def sort_multi_key(t: Tables):
    return t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("limit_and_skip", "O2", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def limit_and_skip(t: Tables):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey")


@query("top_values", "O3", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(t: Tables):
    return so.top_values(t.part, "p_name", 10)


@query("top_k_per_key", "O4", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def top_k_per_key(t: Tables):
    return top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("sorted_set_range", "O5", """
SELECT event_type, event_id, value, rn - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn FROM events)
WHERE rn - 1 BETWEEN 5 AND 14""")
def sorted_set_range(t: Tables):
    head = top_per_group(t.events, ["event_type"], ["value", "event_id"], 15)
    ranked = window_fn(head, "row_number", "rn", partition_by=["event_type"], order_by=["value", "event_id"])
    return ranked.select("event_type", "event_id", "value", (F.col("rn") - 1).alias("position")).where("position between 5 and 14")


@query("argmax_row", "O6", "SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order, max(o_totalprice) AS best_price FROM orders GROUP BY 1")
def argmax_row(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"),
        F.max("o_totalprice").alias("best_price"))


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


@query("set_operations", "U1 U2", f"""
SELECT 'union_all' AS op, k, count(*) AS n FROM ({_A} UNION ALL {_B}) GROUP BY 2
UNION ALL SELECT 'union', k, 1 FROM ({_A} UNION {_B}) UNION ALL SELECT 'intersect', k, 1 FROM ({_A} INTERSECT {_B})
UNION ALL SELECT 'except', k, 1 FROM ({_A} EXCEPT {_B}) UNION ALL SELECT 'intersect_all', k, count(*) FROM ({_A} INTERSECT ALL {_B}) GROUP BY 2
UNION ALL SELECT 'except_all', k, count(*) FROM ({_A} EXCEPT ALL {_B}) GROUP BY 2""")
def set_operations(t: Tables):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    # multiset forms on per-value counts: the same answer without replicating rows
    c = a.select("k", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("k", F.lit(0).alias("x"), F.lit(1).alias("y")))
    c = c.groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))

    def rows(op, n):
        return F.struct(F.lit(op).alias("op"), n.cast("long").alias("n"))

    x, y, one = F.col("x"), F.col("y"), F.lit(1)
    ops = F.array(rows("union_all", x + y), rows("union", one), rows("intersect", F.when((x > 0) & (y > 0), one).otherwise(0)),
                  rows("except", F.when((x > 0) & (y == 0), one).otherwise(0)), rows("intersect_all", F.least(x, y)),
                  rows("except_all", F.greatest(x - y, F.lit(0))))
    return c.select("k", F.inline(ops)).where("n > 0")


@query("set_operations_sql", "U1", f"""
({_A} INTERSECT ALL {_B}) UNION ALL ({_B} EXCEPT ALL {_A}) UNION ALL SELECT r_regionkey FROM region""")
def set_operations_sql(t: Tables):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return a.intersectAll(b).unionByName(b.exceptAll(a)).union(t.region.select("r_regionkey"))


@query("table_compare", "U3", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_first' WHEN a.k IS NULL THEN 'only_second' ELSE 'different' END AS status
FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P') a
FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'F') b
ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")
def table_compare(t: Tables):
    k, v = F.col("o_orderkey").alias("k"), F.col("o_totalprice")
    a = t.orders.where("o_orderstatus <> 'P'").select(k, v.alias("v"))
    b = t.orders.where("o_orderstatus <> 'F'").select(k, F.when(F.col("o_orderpriority") == "1-URGENT", v + 1).otherwise(v).alias("v"))
    return so.compare_tables(a, b, ["k"])


@query("set_membership", "U4", """
SELECT s.set_key, s.member, s.member IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS buyer
FROM (SELECT DISTINCT event_type AS set_key, user_id AS member FROM events WHERE event_type <> 'purchase') s""")
def set_membership(t: Tables):
    sets = so.set_members(t.events.where("event_type <> 'purchase'").select(F.col("event_type").alias("set_key"), F.col("user_id").alias("member")), "set_key", "member")
    buyers = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("member")).distinct()
    inside = so.members_of(sets, "member", buyers).withColumn("buyer", F.lit(True))
    return inside.unionByName(sets.join(buyers, "member", "left_anti").withColumn("buyer", F.lit(False)))
