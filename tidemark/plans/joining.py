"""Join and graph queries."""

from pyspark.sql import functions as F

from tidemark.operators import graph as gr
from tidemark.operators import joins as jn
from tidemark.plans.registry import query
from tidemark.session import Tables


@query("lookup_orders", "J1", """
SELECT c_custkey, 0::BIGINT AS page, count(o_orderkey) AS n_orders, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS order_ids
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""", wide=True)
def lookup_orders(t: Tables):
    d = jn.lookup(t.customer.select("c_custkey"), t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "c_custkey", "o_custkey",
                  "orders", order_by=["o_orderkey"])
    ids = F.array_join(F.transform("orders", lambda o: o.o_orderkey.cast("string")), ",")
    return d.select("c_custkey", "page", F.size("orders").alias("n_orders"), ids.alias("order_ids"))


@query("referential_report", "J2", """
SELECT 'orders.customer' AS rule, count(DISTINCT o_custkey) AS missing, count(*) = 0 AS consistent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.part', count(DISTINCT l_partkey), count(*) = 0 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'labels.large_document', count(DISTINCT doc_id), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)""")
def referential_report(t: Tables):
    return jn.referential_report({
        "orders.customer": (t.orders, "o_custkey", t.customer, "c_custkey"),
        "lineitem.part": (t.lineitem, "l_partkey", t.part, "p_partkey"),
        "labels.large_document": (t.labels, "doc_id", t.documents.where("n_chars > 500"), "doc_id")})


@query("join_inner", "J3", """
SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def join_inner(t: Tables):
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    # combine line items per order first: fewer rows cross the join
    l = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return l.join(o, "l_orderkey").groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


_L = "SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1"
_R = "SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1"


@query("join_outer", "J4", " UNION ALL ".join(
    f"SELECT '{h}' AS how, coalesce(a.k, b.k) AS k, customers, suppliers FROM ({_L}) a {h.upper()} JOIN ({_R}) b ON a.k = b.k" for h in ("left", "right", "full")))
def join_outer(t: Tables):
    a = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    full = a.join(b, "k", "full")
    # left and right are filters of the one full outer result
    how = F.array_compact(F.array(F.lit("full"), F.when(F.col("customers").isNotNull(), "left"), F.when(F.col("suppliers").isNotNull(), "right")))
    return full.select(F.explode(how).alias("how"), "k", "customers", "suppliers")


@query("join_semi_anti", "J5", """
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000) AS urgent FROM customer""")
def join_semi_anti(t: Tables):
    big = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    c = t.customer.select("c_custkey")
    yes, no = c.join(big, "c_custkey", "left_semi"), c.join(big, "c_custkey", "left_anti")
    return yes.withColumn("urgent", F.lit(True)).unionByName(no.withColumn("urgent", F.lit(False)))


@query("theta_count", "J6", """
SELECT c_custkey, (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) AS poorer_suppliers FROM customer""")
def theta_count(t: Tables):
    d = jn.count_below(t.customer.select("c_custkey", "c_acctbal"), t.supplier, "c_acctbal", "s_acctbal", "poorer_suppliers", key=["c_custkey"])
    return d.select("c_custkey", "poorer_suppliers")


@query("range_join", "J7", """
SELECT e.event_id AS error_id, p.event_id FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 2 HOUR
WHERE e.event_type = 'error' AND p.event_type = 'purchase'""")
def range_join(t: Tables):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = 2 * 3600 * 1_000_000
    p = t.events.where("event_type = 'purchase'").select("user_id", "event_id", micros.alias("x"))
    i = t.events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), micros.alias("lo"))
    d = jn.range_join(p, i, F.col("x"), F.col("lo"), F.col("lo") + span, span, keys=["user_id"], point_id=F.col("event_id"))
    return d.select("error_id", "event_id")


@query("asof_join", "J8", """
SELECT p.event_id, v.value AS view_value, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(t: Tables):
    p = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = t.events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"), F.col("event_id").alias("view_id"))
    d = jn.asof_join(p, v, ["user_id"], "ts", "ts", ["view_value", "view_id"], left_key=["event_id"], right_key=["view_id"])
    return d.select("event_id", "view_value", "view_id")


_SUBQUERY = """
SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)
 AND c_acctbal > (SELECT avg(s_acctbal) FROM supplier s WHERE s.s_nationkey = c.c_nationkey)"""


@query("subqueries", "J9 S4", _SUBQUERY)
def subqueries(t: Tables):
    for name in ("customer", "supplier", "orders"):
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark.sql(_SUBQUERY)


@query("star_join", "J10", """
SELECT r_name, n_name, count(*) AS n, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE, 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""")
def star_join(t: Tables):
    l = t.lineitem.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    l = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"))
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    per_nation = l.join(o, "o_orderkey").join(c, "c_custkey").groupBy("n_nationkey").agg(F.sum("n").alias("n"), F.sum("revenue").alias("revenue"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return per_nation.join(n, "n_nationkey").select("r_name", "n_name", "n", F.round(F.col("revenue").cast("double"), 2).alias("revenue"))


@query("recursive_calendar", "J11", """
WITH RECURSIVE m(month_start, last) AS (SELECT date_trunc('month', min(o_orderdate))::DATE, date_trunc('month', max(o_orderdate))::DATE FROM orders
 UNION ALL SELECT (month_start + INTERVAL 1 MONTH)::DATE, last FROM m WHERE month_start < last)
SELECT strftime(month_start, '%Y-%m') AS month, count(o_orderkey) AS n FROM m LEFT JOIN orders ON date_trunc('month', o_orderdate)::DATE = month_start GROUP BY 1""")
def recursive_calendar(t: Tables):
    # the recursion may go as deep as the dates need
    t.orders.createOrReplaceTempView("tm_orders")
    months = t.orders.agg(F.months_between(F.trunc(F.max("o_orderdate"), "MM"), F.trunc(F.min("o_orderdate"), "MM"))).first()[0]
    return t.spark.sql(f"""
      WITH RECURSIVE bounds AS (SELECT cast(trunc(min(o_orderdate), 'MM') AS date) AS lo, cast(trunc(max(o_orderdate), 'MM') AS date) AS hi FROM tm_orders),
      m(month_start, last) MAX RECURSION LEVEL {int(months or 0) + 2} AS (
        SELECT lo, hi FROM bounds UNION ALL SELECT cast(add_months(month_start, 1) AS date), last FROM m WHERE month_start < last),
      counts AS (SELECT cast(trunc(o_orderdate, 'MM') AS date) AS month_start, count(1) AS n FROM tm_orders GROUP BY 1)
      SELECT date_format(m.month_start, 'yyyy-MM') AS month, coalesce(n, 0) AS n FROM m LEFT JOIN counts ON m.month_start = counts.month_start""")


@query("self_join", "J12", """
SELECT a.event_id, b.event_id AS next_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) a
JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) b ON a.user_id = b.user_id AND b.i = a.i + 1
WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def self_join(t: Tables):
    from tidemark.operators.ordered import running

    e = running(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], position="i")
    a = e.where("event_type = 'view'").select("user_id", "event_id", (F.col("i") + 1).alias("i"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("next_id"), "i")
    return a.join(b, ["user_id", "i"]).select("event_id", "next_id")


# Property graph over the star schema: region > nation > customer > order > supplier.
_EDGES_SQL = """
e AS (SELECT 'RN' || n_nationkey AS edge_id, 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation
 UNION ALL SELECT 'NC' || c_custkey, 'N' || c_nationkey, 'C' || c_custkey FROM customer
 UNION ALL SELECT 'CO' || o_orderkey, 'C' || o_custkey, 'O' || o_orderkey FROM orders
 UNION ALL SELECT DISTINCT 'OS' || l_orderkey || '.' || l_suppkey, 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem)"""


def _edges(t: Tables, repeated: bool = False):
    def e(df, tag, ident, a, ac, b, bc):
        return df.select(F.concat(F.lit(tag), *ident).alias("edge_id"), F.concat(F.lit(a), ac).alias("src"), F.concat(F.lit(b), bc).alias("dst"))

    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    lines = lines if repeated else lines.distinct()
    return (
        e(t.nation, "RN", ["n_nationkey"], "R", "n_regionkey", "N", "n_nationkey")
        .unionByName(e(t.customer, "NC", ["c_custkey"], "N", "c_nationkey", "C", "c_custkey"))
        .unionByName(e(t.orders, "CO", ["o_orderkey"], "C", "o_custkey", "O", "o_orderkey"))
        .unionByName(e(lines, "OS", ["l_orderkey", F.lit("."), "l_suppkey"], "O", "l_orderkey", "S", "l_suppkey")))


def _vertices(t: Tables):
    ids = [(t.region, "R", "r_regionkey"), (t.nation, "N", "n_nationkey"), (t.customer, "C", "c_custkey"),
           (t.orders, "O", "o_orderkey"), (t.supplier, "S", "s_suppkey")]
    out = None
    for df, tag, key in ids:
        v = df.select(F.concat(F.lit(tag), key).alias("id"), F.lit(tag).alias("label"))
        out = v if out is None else out.unionByName(v)
    return out


@query("graph_paths", "J13", f"""
WITH RECURSIVE {_EDGES_SQL}, p(node, length, path, used) AS (SELECT dst, 1, src || '>' || dst, [edge_id] FROM e WHERE src = 'R1'
 UNION ALL SELECT e.dst, length + 1, path || '>' || e.dst, list_append(used, e.edge_id) FROM p JOIN e ON e.src = p.node WHERE length < 5 AND NOT list_contains(used, e.edge_id))
SELECT length, path, array_to_string(used, '>') AS edges FROM p WHERE node = 'S3' ORDER BY length, path, edges LIMIT 100""")
def graph_paths(t: Tables):
    return gr.find_paths(_edges(t), "R1", "S3", max_depth=5, limit=100)


@query("graph_neighbors", "J14", f"""
WITH {_EDGES_SQL}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 'C7'),
h2 AS (SELECT DISTINCT dst AS node FROM b JOIN h1 ON b.src = h1.node)
SELECT node FROM (SELECT node FROM h1 UNION SELECT node FROM h2) WHERE node <> 'C7' ORDER BY node LIMIT 1000""")
def graph_neighbors(t: Tables):
    return gr.neighbors(_edges(t), "C7", depth=2)


@query("graph_statistics", "J15", f"""
WITH {_EDGES_SQL} SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)
 + (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM e) AS relationships""")
def graph_statistics(t: Tables):
    return gr.statistics(_vertices(t), _edges(t))


@query("graph_relate", "J16", """
SELECT 'S' || s_suppkey AS src, 'N' || n_nationkey AS dst, 'LOCATED_IN' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def graph_relate(t: Tables):
    s = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    n = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("key"))
    return gr.relate(s, n, "nation", "key", "LOCATED_IN")


@query("graph_detach_delete", "J17", f"""
WITH {_EDGES_SQL}, d AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_acctbal < 0)
SELECT (SELECT count(*) FROM d) AS deleted, (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM d) AND dst NOT IN (SELECT id FROM d)) AS edges_left""")
def graph_detach_delete(t: Tables):
    doomed = t.customer.where("c_acctbal < 0").select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    _, kept = gr.detach_delete(_vertices(t), _edges(t), doomed)
    zero = F.lit(0).cast("long")
    gone = doomed.agg(F.count(F.lit(1)).alias("deleted")).withColumn("edges_left", zero)
    left = kept.agg(F.count(F.lit(1)).alias("edges_left")).withColumn("deleted", zero)
    return gone.unionByName(left).agg(F.sum("deleted").alias("deleted"), F.sum("edges_left").alias("edges_left"))


@query("dependency_levels", "J18 L3", """
SELECT 'R' || r_regionkey AS node, 0 AS level FROM region UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'C' || c_custkey, 2 FROM customer UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) THEN 4 ELSE 0 END FROM supplier
UNION ALL SELECT 'O' || o_orderkey, 3 FROM orders""")
def dependency_levels(t: Tables):
    # a supplier depends on the orders it ships, an order on its customer, that on its nation, and so on
    refs = _edges(t, repeated=True).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return gr.dependency_levels(_vertices(t), refs)


@query("graph_cycles", "J19", """
WITH RECURSIVE e AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1),
z AS (SELECT s.component, count(DISTINCT s.node) AS nodes, (SELECT count(*) FROM e JOIN c p ON p.node = e.src JOIN c q ON q.node = e.dst WHERE p.component = s.component AND q.component = s.component) AS edges
 FROM c s GROUP BY s.component),
f AS (SELECT p.component, e.src AS node, min(e.dst) AS nxt FROM e JOIN c p ON p.node = e.src JOIN c q ON q.node = e.dst AND q.component = p.component GROUP BY 1, 2),
w(component, node, i) AS (SELECT component, component, 0 FROM z UNION ALL SELECT w.component, f.nxt, i + 1 FROM w JOIN f ON f.node = w.node WHERE i < 2 * (SELECT max(nodes) FROM z)),
y AS (SELECT w.component, min(node) AS lo FROM w JOIN z ON z.component = w.component WHERE i >= nodes GROUP BY 1),
s(component, node, step) AS (SELECT component, lo, 0 FROM y UNION ALL SELECT s.component, f.nxt, step + 1 FROM s JOIN f ON f.node = s.node JOIN y ON y.component = s.component WHERE f.nxt <> y.lo)
SELECT z.component, nodes, edges, step, node FROM s JOIN z ON z.component = s.component""")
def graph_cycles(t: Tables):
    # the customer of each order points at the customer of the order after it
    a = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1).alias("o_orderkey"))
    edges = a.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("dst")), "o_orderkey").select("src", "dst")
    return gr.find_cycles(edges)


_FK = [("customer", "c_custkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("region", "r_regionkey"),
       ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"),
       ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey")]


@query("foreign_key_discovery", "J20", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT '{a}.{c}' AS col, {c}::BIGINT AS v FROM {a}" for a, c in _FK) + """), d AS (SELECT col, v, count(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT col, count(*) AS vals, sum(n) AS n FROM d GROUP BY 1)
SELECT a.col AS child, b.col AS parent, count(*) AS child_values FROM d a JOIN d b ON a.v = b.v AND a.col <> b.col JOIN s sa ON sa.col = a.col JOIN s sb ON sb.col = b.col
WHERE sb.vals = sb.n GROUP BY 1, 2, sa.vals HAVING count(*) = sa.vals""")
def foreign_key_discovery(t: Tables):
    return jn.inclusion_dependencies({f"{a}.{c}": (getattr(t, a), c) for a, c in _FK})
