"""Reshape and scalar-function queries."""

from pyspark.sql import functions as F

from tidemark.functions import privacy
from tidemark.functions import scalars as sc
from tidemark.operators import reshape as rs
from tidemark.plans.registry import query
from tidemark.session import Tables

_STATUS = ["F", "O", "P"]


@query("pivot_sum", "V1", "SELECT o_orderpriority, " + ", ".join(
    f"round(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = '{s}')::DOUBLE, 2) AS \"{s}\"" for s in _STATUS) + " FROM orders GROUP BY 1")
def pivot_sum(t: Tables):
    d = rs.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", {"o_totalprice": "sum"})
    return d.select("o_orderpriority", *[F.round(s, 2).alias(s) for s in _STATUS])


_PIVOT_AGGS = {"average": "avg(c_acctbal)", "min": "min(c_acctbal)", "max": "max(c_acctbal)", "count": "count(c_acctbal)",
               "median": "median(c_acctbal)", "stddev": "stddev_pop(c_acctbal)",
               "first": "arg_min(c_acctbal, c_custkey)", "last": "arg_max(c_acctbal, c_custkey)"}
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _cell(name: str, expr: str, label: str) -> str:
    cell = f"({expr} FILTER (c_mktsegment = '{label}'))"
    return f"nullif({cell}, 0)" if name == "count" else cell  # a cell without values is null


@query("pivot_every_aggregate", "V1", " UNION ALL ".join(
    f"SELECT '{n}' AS how, c_nationkey, " + ", ".join(f"round({_cell(n, e, s)}::DOUBLE, 4) AS \"{s}\"" for s in _SEGMENTS)
    + " FROM customer GROUP BY 2" for n, e in _PIVOT_AGGS.items()))
def pivot_every_aggregate(t: Tables):
    out = None
    for how in _PIVOT_AGGS:
        d = rs.pivot(t.customer, ["c_nationkey"], "c_mktsegment", {"c_acctbal": how}, labels=_SEGMENTS, order_by=["c_custkey"])
        d = d.select(F.lit(how).alias("how"), "c_nationkey", *[F.round(F.col(s).cast("double"), 4).alias(s) for s in _SEGMENTS])
        out = d if out is None else out.unionByName(d)
    return out


@query("pivot_first_row", "V2", "SELECT user_id, " + ", ".join(
    f"arg_min(value, event_id) FILTER (event_type = '{s}') AS {s}" for s in ("click", "error", "view")) + " FROM events GROUP BY 1")
def pivot_first_row(t: Tables):
    return rs.pivot(t.events, ["user_id"], "event_type", {"value": "first"}, labels=["click", "error", "view"], order_by=["event_id"])


@query("pivot_multi_value", "V3", "SELECT l_linestatus, " + ", ".join(
    f"sum(l_quantity) FILTER (l_returnflag = '{s}') AS \"{s}_l_quantity\", round(max(l_tax) FILTER (l_returnflag = '{s}'), 4) AS \"{s}_l_tax\"" for s in "ANR")
    + " FROM lineitem GROUP BY 1")
def pivot_multi_value(t: Tables):
    d = rs.pivot(t.lineitem, ["l_linestatus"], "l_returnflag", {"l_quantity": "sum", "l_tax": "max"}, labels=list("ANR"))
    return d.select("l_linestatus", *[c for s in "ANR" for c in (f"{s}_l_quantity", F.round(f"{s}_l_tax", 4).alias(f"{s}_l_tax"))])


@query("unpivot", "V4", """
SELECT p_partkey, 'p_size' AS attribute, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', CASE WHEN p_size > 25 THEN p_retailprice END FROM part""")
def unpivot(t: Tables):
    d = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("price"))
    return rs.unpivot(d, ["p_partkey"], ["p_size", "price"])


@query("crosstab", "V5", "SELECT p_brand, " + ", ".join(
    f"count(*) FILTER (p_type = '{s}') AS \"{s}\"" for s in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part GROUP BY 1")
def crosstab(t: Tables):
    return rs.crosstab(t.part, "p_brand", "p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])


@query("transpose", "V6", """
WITH s AS (SELECT event_type AS k, count(*)::VARCHAR AS n, row_number() OVER (ORDER BY event_type) - 1 AS i FROM events GROUP BY 1)
SELECT c AS column, """ + ", ".join(f"max(CASE WHEN i = {i} THEN CASE c WHEN 'k' THEN k ELSE n END END) AS \"Row{i}\"" for i in range(5))
    + " FROM s, (SELECT unnest(['k', 'n']) AS c) GROUP BY 1")
def transpose(t: Tables):
    # the table to flip is a five-row summary of all events
    return rs.transpose(t.events.groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n")), ["k"])


@query("unwind_words", "V7", """
SELECT item_id, pos, word FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark)""", wide=True)
def unwind_words(t: Tables):
    return t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))


@query("project_add_fields", "V8", """
SELECT o_orderkey, o_totalprice * 1.1 AS gross, o_orderpriority || '/' || o_orderstatus AS tag FROM orders""")
def project_add_fields(t: Tables):
    s = rs.Stages(t.orders).add_fields(gross=F.col("o_totalprice") * 1.1, tag=F.concat_ws("/", "o_orderpriority", "o_orderstatus"))
    return s.project("o_orderkey", "gross", "tag").df


@query("document_stages", "V9", """
SELECT _id, n, top_price, label FROM (SELECT o_custkey AS _id, count(*) AS n, max(o_totalprice) AS top_price, 'cust-' || o_custkey AS label FROM orders
WHERE o_orderstatus <> 'P' GROUP BY 1) ORDER BY top_price DESC, _id LIMIT 40 OFFSET 10""")
def document_stages(t: Tables):
    s = rs.Stages(t.orders).match("o_orderstatus <> 'P'").group("o_custkey", n=F.count(F.lit(1)), top_price=F.max("o_totalprice"))
    s = s.add_fields(label=F.concat(F.lit("cust-"), F.col("_id"))).sort(F.desc("top_price"), "_id").skip(10).limit(40)
    return s.project("_id", "n", "top_price", "label").df


@query("name_similarity", "X4", """
SELECT s_suppkey, n_nationkey, levenshtein(lower(s_name), lower(n_name)) AS d,
 round(1 - levenshtein(lower(s_name), lower(n_name))::DOUBLE / greatest(length(s_name), length(n_name)), 6) AS similarity FROM supplier JOIN nation ON s_nationkey = n_nationkey""", wide=True)
def name_similarity(t: Tables):
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return d.select("s_suppkey", "n_nationkey", F.levenshtein(F.lower("s_name"), F.lower("n_name")).alias("d"),
                    F.round(sc.name_similarity(F.col("s_name"), F.col("n_name")), 6).alias("similarity"))


@query("json_path_value", "X6", "SELECT event_id, props->>'$.k' AS k, props->>'$.no.such' AS missing FROM events")
def json_path_value(t: Tables):
    p = F.col("props")
    return t.events.select("event_id", sc.json_get(p, "k").alias("k"), sc.json_get(p, "no.such").alias("missing"))


@query("json_flatten", "X7", """
SELECT event_id, 'k' AS path, props->>'$.k' AS value, false AS open FROM events
UNION ALL SELECT event_id, 'tags[0]', event_type, false FROM events UNION ALL SELECT event_id, 'tags[1].user', user_id::VARCHAR, false FROM events
UNION ALL SELECT event_id, 'deep' || repeat('[0]', 11), event_id::VARCHAR, false FROM events WHERE event_id % 10 = 3""")
def json_flatten(t: Tables):
    nested = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "tags": ["'), "event_type", F.lit('", {"user": '), "user_id", F.lit("}]"),
                      F.when(F.col("event_id") % 10 == 3, F.concat(F.lit(', "deep": ' + "[" * 11), "event_id", F.lit("]" * 11))).otherwise(""), F.lit("}"))
    return sc.json_flatten(t.events.select("event_id", nested.alias("j")), ["event_id"], "j")


@query("json_edit", "X8", """
SELECT event_id, '{"flag":true,"kk":' || (props->>'$.k') || ',"n":1}' AS props FROM events""")
def json_edit(t: Tables):
    edits = [("add", "n", "0"), ("replace", "n", "1"), ("rename", "k", "kk"), ("rename", "absent", "x"), ("add", "tmp", '"a"'), ("remove", "tmp"), ("add", "flag", "true")]
    return t.events.select("event_id", sc.json_edit(F.col("props"), edits).alias("props"))


@query("calendar_parts", "X9 M19", """
SELECT event_id, hour(ts) AS hour, dayofweek(ts) AS day_of_week, month(ts) AS month, quarter(ts) AS quarter, day(ts) AS day, dayofweek(ts) IN (0, 6) AS is_weekend FROM events""", wide=True)
def calendar_parts(t: Tables):
    return t.events.select("event_id", *[c.alias(n) for n, c in sc.date_parts(F.col("ts")).items()])


@query("time_bucket", "X10", "SELECT floor(epoch(ts) / 900)::BIGINT * 900 AS bucket, count(*) AS n FROM events GROUP BY 1")
def time_bucket(t: Tables):
    return t.events.groupBy(sc.time_bucket(F.col("ts"), 900).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("cosine_to_first", "X11", """
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS cosine FROM embeddings""")
def cosine_to_first(t: Tables):
    # one target vector, as a literal
    target = F.array(*[F.lit(float(x)) for x in t.embeddings.agg(F.min_by("embedding", "vec_id")).first()[0]])
    return t.embeddings.select("vec_id", F.round(sc.cosine_similarity(F.col("embedding"), target), 6).alias("cosine"))


@query("text_statistics", "X12", "SELECT lang, min(length(text)) AS lo, max(length(text)) AS hi, round(avg(length(text)), 4) AS mean FROM documents GROUP BY 1", wide=True)
def text_statistics(t: Tables):
    n = F.length("text")
    return t.documents.groupBy("lang").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.round(F.avg(n), 4).alias("mean"))


@query("string_functions", "X13", """
SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substr(c_name, 10, 5) AS sub, lpad(c_custkey::VARCHAR, 8, '0') AS pad, replace(c_name, '#', '-') AS rep,
 reverse(c_mktsegment) AS rev, trim('  ' || c_mktsegment || ' ') AS tr, strpos(c_name, '#') AS pos, split_part(c_name, '#', 2) AS part, length(c_name) AS len,
 regexp_extract(c_name, '([0-9]+)', 1) AS num, c_name LIKE '%7' AS ends7, md5(c_name) AS md FROM customer""", wide=True)
def string_functions(t: Tables):
    return t.customer.selectExpr("c_custkey", "upper(c_mktsegment) up", "lower(c_name) low", "substr(c_name, 10, 5) sub", "lpad(cast(c_custkey as string), 8, '0') pad",
                                 "replace(c_name, '#', '-') rep", "reverse(c_mktsegment) rev", "trim(concat('  ', c_mktsegment, ' ')) tr", "instr(c_name, '#') pos",
                                 "split_part(c_name, '#', 2) part", "length(c_name) len", "regexp_extract(c_name, '([0-9]+)', 1) num", "c_name LIKE '%7' ends7", "md5(c_name) md")


@query("date_functions", "X13", """
SELECT o_orderkey, year(o_orderdate) AS y, strftime(o_orderdate, '%Y/%m/%d') AS text, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q_start,
 date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS later, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
 dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS week FROM orders""", wide=True)
def date_functions(t: Tables):
    return t.orders.selectExpr("o_orderkey", "year(o_orderdate) y", "date_format(o_orderdate, 'yyyy/MM/dd') text", "date_format(date_trunc('quarter', o_orderdate), 'yyyy-MM-dd') q_start",
                               "datediff(o_orderdate, date'1995-01-01') days", "date_format(o_orderdate + interval 45 days, 'yyyy-MM-dd') later",
                               "date_format(last_day(o_orderdate), 'yyyy-MM-dd') month_end", "dayofyear(o_orderdate) doy", "weekofyear(o_orderdate) week")


@query("math_functions", "X13", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, abs(l_discount - 0.05) AS a, ceil(l_extendedprice)::BIGINT AS c, floor(l_extendedprice)::BIGINT AS f, round(sqrt(l_extendedprice), 6) AS s,
 round(ln(l_extendedprice), 6) AS l, round(power(l_quantity, 1.5), 4) AS p, l_orderkey % 7 AS m, sign(l_discount - 0.05)::INTEGER AS g, greatest(l_tax, l_discount) AS mx, round(degrees(atan2(l_quantity, l_extendedprice)), 6) AS d FROM lineitem""")
def math_functions(t: Tables):
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "abs(l_discount - 0.05D) a", "ceil(l_extendedprice) c", "floor(l_extendedprice) f",
                                 "round(sqrt(l_extendedprice), 6) s", "round(ln(l_extendedprice), 6) l", "round(power(l_quantity, 1.5D), 4) p", "l_orderkey % 7 m",
                                 "cast(sign(l_discount - 0.05D) as int) g", "greatest(l_tax, l_discount) mx", "round(degrees(atan2(l_quantity, l_extendedprice)), 6) d")


@query("collection_functions", "X13", """
WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark)
SELECT item_id, len(w) AS n, w[1] AS first_word, list_contains(w, 'the') AS has_the, len(list_distinct(w)) AS n_distinct, array_to_string(list_sort(w)[1:5], ' ') AS low5,
 len(list_filter(w, lambda x: length(x) > 6)) AS n_long, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars FROM w""", wide=True)
def collection_functions(t: Tables):
    w = t.benchmark.select("item_id", F.split(F.lower("text"), " ").alias("w"))
    return w.selectExpr("item_id", "size(w) n", "w[0] first_word", "array_contains(w, 'the') has_the", "size(array_distinct(w)) n_distinct",
                        "array_join(slice(array_sort(w), 1, 5), ' ') low5", "size(filter(w, x -> length(x) > 6)) n_long",
                        "aggregate(w, 0L, (s, x) -> s + length(x)) chars")


@query("map_functions", "X13", """
SELECT c_mktsegment, count(*) AS entries, string_agg(k || '=' || n, ',' ORDER BY k) AS entries_text FROM (SELECT c_mktsegment, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""", wide=True)
def map_functions(t: Tables):
    # nation keys per segment: the map is bounded by the nation table
    per = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy("c_mktsegment").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_nationkey", "n")))).alias("m"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return m.select("c_mktsegment", F.size("m").alias("entries"), text.alias("entries_text"))


@query("type_tests", "X14 I2", """
SELECT 'url' AS col, count(*) FILTER (regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:\\S+$')) AS hits FROM pages
UNION ALL SELECT 'props', count(*) FILTER ((props LIKE '{%' AND props LIKE '%}')) FROM events
UNION ALL SELECT 'o_orderkey', count(*) FILTER (lower(o_orderkey::VARCHAR) IN ('1','0')) FROM orders
UNION ALL SELECT 'o_totalprice', count(*) FILTER (regexp_matches(o_totalprice::VARCHAR, '^[0-9]+(\\.[0-9]+)?$')) FROM orders
UNION ALL SELECT 'o_orderdate', count(*) FROM orders UNION ALL SELECT 'o_custkey', count(*) FROM orders""")
def type_tests(t: Tables):
    def hits(df, c, kind):
        return df.agg(F.count_if(sc.type_tests(F.col(c).cast("string"))[kind]).alias("hits")).select(F.lit(c).alias("col"), "hits")

    parts = [hits(t.pages, "url", "Url"), hits(t.events, "props", "Json"), hits(t.orders, "o_orderkey", "Boolean"),
             hits(t.orders, "o_totalprice", "Decimal"), hits(t.orders, "o_orderdate", "DateTime"), hits(t.orders, "o_custkey", "Integer")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
