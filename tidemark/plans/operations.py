"""Lineage, operational analytics, search and plug-in queries."""

from pyspark.sql import functions as F

from tidemark.functions import privacy
from tidemark.operators import graph as gr
from tidemark.operators import operations as op
from tidemark.operators.reshape import transform_all
from tidemark.plans.joining import _EDGES_SQL, _edges
from tidemark.plans.registry import query
from tidemark.session import Tables


def _entries(t: Tables):
    steps = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "mask"), F.when(F.col("o_totalprice") > 150000, "hash")))
    return t.orders.select(
        F.col("o_orderkey").alias("lineage_id"), F.concat(F.lit("ws"), "o_orderstatus").alias("source_workspace"), F.lit("lake").alias("source_lakehouse"),
        F.col("o_orderpriority").alias("table_name"), F.concat(F.lit("/out/"), F.col("o_custkey").cast("string")).alias("target_path"), steps.alias("transformations"))


_ENTRIES = """
n AS (SELECT o_orderkey AS id, 'ws' || o_orderstatus || '/lake/' || o_orderpriority AS src, '/out/' || o_custkey AS dst, o_orderpriority AS tname, o_custkey::VARCHAR AS oname,
 list_filter([CASE WHEN o_orderstatus = 'F' THEN 'mask' END, CASE WHEN o_totalprice > 150000 THEN 'hash' END], lambda x: x IS NOT NULL) AS steps FROM orders),
s AS (SELECT id, src, dst, unnest(steps) AS step FROM n)"""


@query("lineage_nodes", "L2", f"WITH {_ENTRIES} SELECT DISTINCT src AS id, 'Source' AS type, tname AS name FROM n UNION ALL SELECT DISTINCT dst, 'Target', oname FROM n UNION ALL SELECT id || '_' || step, 'Transformation', step FROM s")
def lineage_nodes(t: Tables):
    return op.lineage_nodes(_entries(t))


@query("lineage_edges", "L2", f"WITH {_ENTRIES} SELECT id AS lineage_id, src, dst, 'sync' AS operation FROM n UNION ALL SELECT id, src, id || '_' || step, 'transform' FROM s UNION ALL SELECT id, id || '_' || step, dst, 'output' FROM s")
def lineage_edges(t: Tables):
    return op.lineage_edges(_entries(t))


@query("lineage_upstream", "L3", f"""
WITH RECURSIVE {_EDGES_SQL}, u(node, dist) AS (SELECT 'S3', 0 UNION SELECT e.src, dist + 1 FROM u JOIN e ON e.dst = u.node WHERE dist < 5)
SELECT node, min(dist) AS dist FROM u GROUP BY 1""")
def lineage_upstream(t: Tables):
    return gr.distance_to(_edges(t), "S3", 5)


def _calls(t: Tables):
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 400).otherwise(399)
    user = F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string"))
    return t.events.select(F.concat(F.lit("/api/"), "event_type").alias("path"), status.alias("status"), F.col("value").alias("duration_ms"), user.alias("user"), "ts")


@query("api_summary", "L4", "SELECT count(*) AS calls, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS ok, count(*) FILTER (event_type IN ('error', 'signup')) AS failed, round(avg(value), 4) AS mean_ms FROM events")
def api_summary(t: Tables):
    return op.api_summary(_calls(t)).withColumn("mean_ms", F.round("mean_ms", 4))


@query("api_top_callers", "L4", """
SELECT * FROM (SELECT 'path' AS kind, '/api/' || event_type AS name, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'user', CASE WHEN user_id % 10 <> 0 THEN user_id::VARCHAR ELSE 'anonymous' END AS name, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, name LIMIT 10)""")
def api_top_callers(t: Tables):
    by = {"path": F.col("path"), "user": F.coalesce("user", F.lit("anonymous"))}
    parts = [op.top_callers(_calls(t), c).select(F.lit(k).alias("kind"), "name", "n") for k, c in by.items()]
    return parts[0].unionByName(parts[1])


@query("operation_profile", "L5", """
SELECT '/api/' || event_type AS path, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS total, round(avg(value), 4) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1""")
def operation_profile(t: Tables):
    return op.operation_profile(_calls(t), "path", "duration_ms").withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("metric_alerts", "L6 F4", """
SELECT event_id, 'slow-view' AS rule, 'High' AS severity FROM events WHERE event_type = 'view' AND value > 200 UNION ALL SELECT event_id, 'tiny-purchase', 'Low' FROM events WHERE event_type = 'purchase' AND value <= 1""")
def metric_alerts(t: Tables):
    rules = t.spark.createDataFrame([("slow-view", "view", ">", 200.0, "High"), ("tiny-purchase", "purchase", "<=", 1.0, "Low")],
                                    "rule string, metric string, op string, threshold double, severity string")
    return op.alerts(t.events.select("event_id", F.col("event_type").alias("metric"), "value"), rules).select("event_id", "rule", "severity")


@query("sla_report", "L7", "SELECT '/api/' || event_type AS path, count(*) AS requests, count(*) FILTER (value > 100) AS violations, round((count(*) - count(*) FILTER (value > 100))::DOUBLE / count(*) * 100, 6) AS uptime_pct FROM events GROUP BY 1")
def sla_report(t: Tables):
    return op.sla_report(_calls(t), "path", "duration_ms", 100).withColumn("uptime_pct", F.round("uptime_pct", 6))


# One query text per order, by status and priority digit.
_TEXTS = {
    "1": "SELECT * FROM sales", "2": "SELECT a FROM t WHERE city = ''x'' OR city = ''y''", "3": "SELECT a FROM t WHERE lower(name) = ''z''",
    "4": "SELECT a, b FROM t, u WHERE t.id = u.id", "5": "SELECT (SELECT max(b) FROM u) FROM t WHERE k = 1",
}
_TAILS = {"F": " UNION SELECT DISTINCT a FROM v", "O": " UNION ALL SELECT a FROM v", "P": ""}
_TEXT_SQL = ("CASE left(o_orderpriority, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TEXTS.items())
             + " END || CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TAILS.items()) + " END || CASE WHEN o_orderkey % 4 = 0 THEN ' -- DISTINCT' ELSE '' END")
_Q = f"WITH q AS (SELECT o_orderkey, {_TEXT_SQL} AS q, left(o_orderpriority, 1) AS k FROM orders)"
_ISSUES = [("select_star", "Medium", "regexp_matches(q, '(?i)SELECT\\s+\\*\\s+FROM')"), ("or_chain", "Low", "k = '2'"), ("function_in_where", "High", "regexp_matches(q, '(?i)WHERE\\s+\\w+\\([^)]+\\)\\s*[=<>]')"),
           ("comma_join", "Medium", "regexp_matches(q, '(?i)FROM\\s+\\w+\\s*,\\s*\\w+')"), ("scalar_subquery", "Medium", "regexp_matches(q, '(?i)SELECT[^,]*\\([^)]*SELECT')"),
           ("union_without_all", "Low", "len(regexp_extract_all(q, '(?i)\\bUNION\\s')) > len(regexp_extract_all(q, '(?i)\\bUNION\\s+ALL'))"),
           ("missing_where", "High", "NOT regexp_matches(q, '(?i)\\bWHERE\\b') AND NOT regexp_matches(q, '(?i)\\b(INNER|LEFT|RIGHT|FULL)\\s+JOIN\\b')"),
           ("repeated_distinct", "Medium", "len(regexp_extract_all(q, '(?i)\\bDISTINCT\\b')) > 1")]
_LINT_SQL = " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS issue, '{s}' AS severity FROM q WHERE {w}" for n, s, w in _ISSUES)


def _texts(t: Tables):
    def pick(table, key):
        return F.create_map(*[F.lit(x.replace("''", "'")) for kv in table.items() for x in kv])[key]

    note = F.when(F.col("o_orderkey") % 4 == 0, " -- DISTINCT").otherwise("")
    text = F.concat(pick(_TEXTS, F.left("o_orderpriority", F.lit(1))), pick(_TAILS, F.col("o_orderstatus")), note)
    return t.orders.select("o_orderkey", text.alias("q"))


@query("query_lint", "L8", f"{_Q} {_LINT_SQL}")
def query_lint(t: Tables):
    return op.lint(_texts(t), "o_orderkey", "q")


@query("query_lint_overall", "L8", f"""{_Q}, i AS ({_LINT_SQL}) SELECT o_orderkey, count(*) AS issues,
 CASE max(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS overall FROM i GROUP BY 1""")
def query_lint_overall(t: Tables):
    return op.worst_severity(op.lint(_texts(t), "o_orderkey", "q"), "o_orderkey")


@query("full_text_search", "L9", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM w),
tf AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS token FROM w) WHERE token IN ('license', 'data', 'the', 'copyright') GROUP BY 1, 2, 3),
idf AS (SELECT token, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1)
SELECT doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT al FROM st)))), 6) AS score FROM tf JOIN idf USING (token) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def full_text_search(t: Tables):
    return op.search(t.documents, "doc_id", "text", "License data, the copyright", 20).withColumn("score", F.round("score", 6))


@query("json_processing", "L10", "SELECT event_type = 'error' AS error, count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN (props->>'$.k')::BIGINT END)::BIGINT AS total FROM events GROUP BY 1")
def json_processing(t: Tables):
    broken = F.when(F.col("event_type") == "error", F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    d = op.process_json(t.events.select("event_id", broken.alias("j")), "event_id", "j", "k bigint")
    return d.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("error"), F.col("parsed.k"))).alias("total"))


@query("named_plugins", "F1 F5 V9", "SELECT c_custkey, upper(sha256(c_name)) AS c_name, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_acctbal > 0")
def named_plugins(t: Tables):
    p = op.Plugins()
    p.register("positive", lambda d: d.where("c_acctbal > 0"))
    p.register("hash-name", lambda d: d.withColumn("c_name", privacy.sha256_hex(F.col("c_name"))))
    return transform_all(p.apply(t.customer, ["identity", "positive", "hash-name"]), [
        lambda d: d.withColumn("c_acctbal", F.col("c_acctbal") * 2), lambda d: d.select("c_custkey", "c_name", "c_acctbal")])
