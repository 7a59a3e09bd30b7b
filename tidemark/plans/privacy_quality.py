"""Privacy, profiling, validation and schema queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import privacy as pv
from tidemark.operators import personal_data as pd_
from tidemark.operators import quality as ql
from tidemark.operators.quality import Rule
from tidemark.plans.registry import query
from tidemark.session import TABLE_NAMES, Tables, spread


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("pii_spans", "R1", " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS type, len(m) AS n, list_sum(list_transform(m, lambda x: length(x)))::BIGINT AS chars, true AS in_place "
    f"FROM (SELECT doc_id, regexp_extract_all(text, '{_re2(p)}') AS m FROM documents) WHERE len(m) > 0" for n, p in pv.PATTERNS.items()))
def pii_spans(t: Tables):
    s = pd_.spans(t.documents.select("doc_id", "text"), ["doc_id"], "text")
    s = s.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"), F.collect_list(F.struct("start", "value")).alias("at"))
    # every reported span must read its own value back from the text
    back = s.join(t.documents.select("doc_id", "text"), "doc_id")
    ok = F.forall("at", lambda a: F.substr(F.col("text"), a.start + 1, F.length(a.value)) == a.value)
    return back.select("doc_id", "type", "n", "chars", ok.alias("in_place"))


# every text column of the given tables; embeddings and labels have none
_TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}


def _of_all_tables(t: Tables, report):
    """``report(table, name)`` of every table with text, together."""
    return reduce(DataFrame.unionByName, [report(getattr(t, name), name) for name in _TEXT_COLUMNS])


def _likely(then: str) -> str:
    return "[" + ", ".join(f"CASE WHEN \"{n}\" >= total * 0.5 THEN {then.format(n=n)} END" for n in pv.PATTERNS) + "]"


@query("pii_columns", "R2", f"SELECT *, array_to_string(list_filter({_likely("'{n}'")}, lambda x: x IS NOT NULL), ',') AS likely, "
    + f"round(list_filter({_likely('"{n}"::DOUBLE / total * 100')}, lambda x: x IS NOT NULL)[1], 6) AS percentage FROM (" + " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, '{c}' AS \"column\", count(*) AS total, " + ", ".join(f"count(*) FILTER (regexp_matches({c}, '{_re2(p)}')) AS \"{n}\"" for n, p in pv.PATTERNS.items())
    + f" FROM {tb}" for tb, cs in _TEXT_COLUMNS.items() for c in cs) + ")")
def pii_columns(t: Tables):
    d = _of_all_tables(t, lambda df, name: pd_.analyze_columns(df).withColumn("table_name", F.lit(name)))
    return d.withColumn("percentage", F.round("percentage", 6))


def _redact_sql(column: str, to: str) -> str:
    out = column
    for n, p in pv.PATTERNS.items():
        out = f"regexp_replace({out}, '{_re2(p)}', '{to.format(n=n)}', 'g')"
    return out


@query("pii_redact_text", "R3", f"""
SELECT doc_id, md5({_redact_sql('text', '[{n}]')}) AS redacted, md5({_redact_sql('text', '')}) AS removed FROM documents""")
def pii_redact_text(t: Tables):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.md5(pv.mask_pii(F.col("text"), "redact")).alias("redacted"), F.md5(pv.mask_pii(F.col("text"), "remove")).alias("removed"))


@query("pii_mask_text_values", "R3")
def pii_mask_text_values(t: Tables):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", pv.mask_pii(F.col("text"), "partial").alias("partial"), pv.mask_pii(F.col("text"), "hash").alias("hashed"))


@query("mask_whole_values", "R4 R5", """
WITH v AS (SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@mail.example.com' AS email, '555-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone,
 '123-45-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS ssn, '4111 1111 1111 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS card, lpad(c_custkey::VARCHAR, 5, '0') AS zip, c_name FROM customer)
SELECT c_custkey, left(split_part(email, '@', 1), 1) || repeat('*', length(split_part(email, '@', 1)) - 2) || right(split_part(email, '@', 1), 1) || '@mail.example.com' AS email,
 '******' || right(phone, 4) AS phone, '***-**-' || right(ssn, 4) AS ssn, '**** **** **** ' || right(card, 4) AS card, '*' || right(zip, 4) AS zip, left(upper(sha256(c_name)), 16) AS hashed FROM v""")
def mask_whole_values(t: Tables):
    four = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    v = t.customer.select(
        "c_custkey", "c_name", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example.com")).alias("email"),
        F.concat(F.lit("555-"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("-"), four).alias("phone"),
        F.concat(F.lit("123-45-"), four).alias("ssn"), F.concat(F.lit("4111 1111 1111 "), four).alias("card"), F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("zip"))
    kinds = {"email": "Email", "phone": "Phone", "ssn": "SSN", "card": "CreditCard", "zip": "ZipCode"}
    return v.select("c_custkey", *[pv.mask_value(F.col(c), k).alias(c) for c, k in kinds.items()], pv.policy_hash(F.col("c_name")).alias("hashed"))


_ANY = "({})".format(" OR ".join(f"regexp_matches({{c}}, '{_re2(p)}')" for p in pv.SCAN_PATTERNS.values()))


@query("pii_table_scan", "R6", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, '{c}' AS \"column\", array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN count(*) FILTER (regexp_matches({c}, '{_re2(p)}')) > 0 THEN '{n}' END" for n, p in pv.SCAN_PATTERNS.items())
    + f"], lambda x: x IS NOT NULL), ',') AS types, count(*) FILTER ({_ANY.replace('{c}', c)}) AS matches, round(count(*) FILTER ({_ANY.replace('{c}', c)})::DOUBLE / count({c}) * 100, 6) AS confidence FROM {tb}"
    for tb, cs in _TEXT_COLUMNS.items() for c in cs) + ") WHERE matches > 0")
def pii_table_scan(t: Tables):
    return _of_all_tables(t, pd_.scan_table).withColumn("confidence", F.round("confidence", 6))


@query("redact_columns", "R7", """
SELECT c_custkey, '[REDACTED]' AS c_name, repeat('*', length(c_mktsegment)) AS c_mktsegment, upper(sha256(c_nationkey::VARCHAR)) AS hashed,
 'TOKEN_' || left(sha256(r || ':' || c_custkey), 32) AS token FROM (SELECT *, c_mktsegment AS r FROM customer)""")
def redact_columns(t: Tables):
    d = pd_.redact(t.customer.withColumns({"salt": F.col("c_mktsegment"), "hashed": F.col("c_nationkey"), "token": F.col("c_custkey")}), ["c_name"], "replace")
    d = pd_.redact(pd_.redact(d, ["c_mktsegment"], "mask"), ["hashed"], "hash")
    return pd_.redact(d, ["token"], "tokenize", F.col("salt")).select("c_custkey", "c_name", "c_mktsegment", "hashed", "token")


@query("subject_export", "R8", """
SELECT 'customer' AS table_name, c_custkey AS id FROM customer WHERE c_custkey = 42 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey = 42
UNION ALL SELECT 'events', event_id FROM events WHERE user_id = 42""")
def subject_export(t: Tables):
    d = pd_.subject_export({"customer": (t.customer, "c_custkey"), "orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")}, 42)
    ident = F.coalesce(*[F.get_json_object("record", f"$.{k}") for k in ("o_orderkey", "event_id", "c_custkey")])
    return d.select("table_name", ident.cast("long").alias("id"))


@query("subject_erasure", "R9", """
WITH s AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < -500)
SELECT 'orders' AS table_name, count(*) FILTER (o_custkey IN (SELECT id FROM s)) AS deleted, count(*) FILTER (o_custkey NOT IN (SELECT id FROM s)) AS kept FROM orders
UNION ALL SELECT 'customer', count(*) FILTER (c_custkey IN (SELECT id FROM s)), count(*) FILTER (c_custkey NOT IN (SELECT id FROM s)) FROM customer""")
def subject_erasure(t: Tables):
    gone = t.customer.where("c_acctbal < -500").select("c_custkey")
    out = None
    for name, df, c in (("orders", t.orders, "o_custkey"), ("customer", t.customer, "c_custkey")):
        kept, deleted = pd_.subject_erasure(df, c, gone)
        row = deleted.withColumn("kept", F.lit(0).cast("long")).unionByName(kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("deleted", F.lit(0).cast("long")))
        row = row.agg(F.sum("deleted").alias("deleted"), F.sum("kept").alias("kept")).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("consent_latest", "R10", "SELECT user_id, event_type AS purpose, arg_max(value > 50, (ts, event_id)) AS granted FROM events GROUP BY 1, 2")
def consent_latest(t: Tables):
    log = t.events.select("user_id", F.col("event_type").alias("purpose"), (F.col("value") > 50).alias("granted"), "ts", "event_id")
    return pd_.latest_records(log, ["user_id", "purpose"], ["ts", "event_id"], ["granted"])


@query("row_level_access", "R11", """
SELECT 'admin' AS role, c_custkey FROM customer UNION ALL SELECT 'user', c_custkey FROM customer WHERE c_custkey = 5
UNION ALL SELECT 'manager', c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 5)""")
def row_level_access(t: Tables):
    members = t.supplier.select(F.col("s_suppkey").alias("user"), F.col("s_nationkey").alias("department"))
    out = None
    for role in ("admin", "manager", "user"):
        d = pd_.rows_for(t.customer, 5, [role], owner="c_custkey", department="c_nationkey", memberships=members)
        d = d.select(F.lit(role).alias("role"), "c_custkey")
        out = d if out is None else out.unionByName(d)
    return out


@query("column_encryption", "R12", "SELECT c_custkey, c_name, true AS differs FROM customer")
def column_encryption(t: Tables):
    keys = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.md5("n_name").alias("secret"))
    enc = pd_.encrypt_column(t.customer.select("c_custkey", "c_nationkey", F.col("c_name").alias("plain")), "plain", keys, "c_nationkey", "cipher")
    dec = pd_.decrypt_column(enc, "cipher", keys, "c_nationkey", "c_name")
    return dec.select("c_custkey", "c_name", (F.col("cipher") != F.col("plain")).alias("differs"))


_ORD = ["o_orderkey", "o_custkey", "status", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORD_SQL = "(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, o_totalprice, o_orderdate, o_orderpriority FROM orders)"


def _orders(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice", "o_orderdate", "o_orderpriority")


@query("profile_columns", "Q1", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", round((count(*) - count({c}))::DOUBLE / count(*) * 100, 4) AS null_pct, "
    f"round(count(DISTINCT {c})::DOUBLE / count(*) * 100, 4) AS unique_pct FROM {_ORD_SQL}" for c in _ORD))
def profile_columns(t: Tables):
    return ql.profile(_orders(t)).withColumns({"null_pct": F.round("null_pct", 4), "unique_pct": F.round("unique_pct", 4)})


@query("profile_type_classes", "Q2", """
WITH v AS (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM orders) ON * INTO NAME col VALUE v),
c AS (SELECT col, count(v) AS n, count(try_cast(v AS DOUBLE)) AS x, count(try_cast(v AS TIMESTAMP)) FILTER (try_cast(v AS DOUBLE) IS NULL) AS d FROM v GROUP BY 1)
SELECT col AS "column", CASE WHEN x > 0.8 * n THEN 'Numeric' WHEN d > 0.8 * n THEN 'Date' ELSE 'String' END AS class FROM c""")
def profile_type_classes(t: Tables):
    return ql.type_classes(t.orders.select(*[F.col(c).cast("string").alias(c) for c in t.orders.columns]))


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric", "Q3", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min(x) AS lo, max(x) AS hi, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS sd, round(var_pop(x), 2) AS var, max(x) FILTER (i = n // 2) AS median "
    f"FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM lineitem)" for c in _LINE_NUMBERS))
def profile_numeric(t: Tables):
    d = ql.numeric_profile(t.lineitem, _LINE_NUMBERS)
    return d.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4), "var": F.round("var", 2)})


@query("profile_text", "Q4", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min(length({c})) AS min_len, max(length({c})) AS max_len, round(avg(length({c})), 4) AS avg_len FROM documents" for c in ("text", "lang", "source")), wide=True)
def profile_text(t: Tables):
    return ql.text_profile(t.documents, ["text", "lang", "source"]).withColumn("avg_len", F.round("avg_len", 4))


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("profile_top_values", "Q4 O3", "SELECT \"column\", value, n FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM part GROUP BY 2" for c in _PART)
    + ") QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) <= 10")
def profile_top_values(t: Tables):
    return ql.top_values(t.part, t.part.columns, 10)


@query("profile_dates", "Q5", """
SELECT 'l_shipdate' AS "column", strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last, date_diff('second', min(l_shipdate), max(l_shipdate)) AS range_seconds FROM lineitem""")
def profile_dates(t: Tables):
    d = ql.date_profile(t.lineitem, ["l_shipdate"])
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query("quality_report", "Q6 Q7 Q8 Q9 Q10", f"""
WITH m AS (SELECT 'completeness' AS metric, (count(o_orderkey) + count(o_custkey) + count(status) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority))::DOUBLE / (6 * count(*)) * 100 AS value FROM {_ORD_SQL}
UNION ALL SELECT 'uniqueness_o_orderkey', count(DISTINCT o_orderkey)::DOUBLE / count(*) * 100 FROM orders
UNION ALL SELECT 'uniqueness_status', (count(DISTINCT status) + max(CASE WHEN status IS NULL THEN 1 ELSE 0 END))::DOUBLE / count(*) * 100 FROM {_ORD_SQL}
UNION ALL SELECT 'validity_o_totalprice', avg(CASE WHEN o_totalprice BETWEEN 1000 AND 350000 THEN 1 ELSE 0 END) * 100 FROM orders
UNION ALL SELECT 'validity_status', avg(CASE WHEN status IN ('F', 'O') THEN 1 ELSE 0 END) * 100 FROM {_ORD_SQL}
UNION ALL SELECT 'consistency', avg(ok) * 100 FROM (SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE 0.0 END AS ok FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE 0.0 END FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)))
SELECT metric, round(value, 6) AS value, CASE WHEN metric = 'completeness' AND value < 95 THEN 'High' WHEN metric LIKE 'uniqueness%' AND value < 100 THEN 'Medium'
 WHEN metric LIKE 'validity%' AND value < 95 THEN 'Medium' END AS severity FROM m UNION ALL SELECT 'overall_score', round(avg(value), 6), NULL FROM m""")
def quality_report(t: Tables):
    rules = ql.QualityRules(unique=["o_orderkey", "status"], valid={"o_totalprice": F.col("o_totalprice").between(1000, 350000), "status": F.col("status").isin("F", "O")},
                            references={"customer": ("o_custkey", t.customer, "c_custkey"), "lines": ("o_orderkey", t.lineitem, "l_orderkey")})
    return ql.quality_report(_orders(t), rules).withColumn("value", F.round("value", 6))


def _rules():
    return [Rule("status", "required", message="status is missing"), Rule("o_totalprice", "range", 5000, 300000), Rule("o_orderpriority", "pattern", pattern="^[1-4]-"),
            Rule("o_orderpriority", "length", 5, 12, severity="Warning"), Rule("o_custkey", "custom", predicate=F.col("o_custkey") % 3 != 0)]


_FAILS = [("required:status", "status", "Error", "status", "status IS NULL"), ("range:o_totalprice", "o_totalprice", "Error", "o_totalprice", "NOT (o_totalprice BETWEEN 5000 AND 300000)"),
          ("pattern:o_orderpriority", "o_orderpriority", "Error", "o_orderpriority", "NOT regexp_matches(o_orderpriority, '^[1-4]-')"),
          ("length:o_orderpriority", "o_orderpriority", "Warning", "o_orderpriority", "NOT (length(o_orderpriority) BETWEEN 5 AND 12)"),
          ("custom:o_custkey", "o_custkey", "Error", "o_custkey", "o_custkey % 3 = 0")]


@query("validation_violations", "Q11 Q12 F2 F3", " UNION ALL ".join(
    f"SELECT o_orderkey, '{r}' AS rule, '{c}' AS \"column\", '{s}' AS severity FROM {_ORD_SQL} WHERE {w}" for r, c, s, _, w in _FAILS))
def validation_violations(t: Tables):
    return ql.violations(_orders(t), ["o_orderkey"], _rules()).select("o_orderkey", "rule", "column", "severity")


@query("validation_summary", "Q13", f"""
WITH v AS (SELECT {' + '.join(f'CASE WHEN {w} THEN 1 ELSE 0 END' for *_, w in _FAILS)} AS bad FROM {_ORD_SQL})
SELECT count(*) AS total, count(*) FILTER (bad = 0) AS valid, count(*) FILTER (bad > 0) AS invalid, sum(bad)::BIGINT AS violations, round(count(*) FILTER (bad = 0)::DOUBLE / count(*) * 100, 6) AS pass_pct FROM v""")
def validation_summary(t: Tables):
    return ql.validation_summary(_orders(t), _rules()).withColumn("pass_pct", F.round("pass_pct", 6))


def _raw(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _mixed(t: Tables):
    e = t.events
    return _raw(e.select("event_id", "event_type", "value", F.col("ts").alias("at"), "props", F.when(F.col("user_id") % 2 == 0, "yes").otherwise("N").alias("flag"),
                         F.when(F.col("value") > 50, F.concat("event_type", F.lit("@x.org"))).alias("mail")))


@query("infer_schema", "I1 I2", r"""
WITH m AS (SELECT event_id::VARCHAR AS event_id, event_type, value::VARCHAR AS value, ts::VARCHAR AS "at", props, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'N' END AS flag, CASE WHEN value > 50 THEN event_type || '@x.org' END AS mail FROM events),
v AS (SELECT col, v FROM m UNPIVOT INCLUDE NULLS (v FOR col IN (event_id, event_type, value, "at", props, flag, mail))),
c AS (SELECT col, count(*) AS total, count(v) AS filled, count(*) FILTER (lower(v) IN ('true', 'false', 'yes', 'no', '1', '0', 't', 'f', 'y', 'n')) AS b, count(*) FILTER (regexp_full_match(v, '\s*[+-]?[0-9]+\s*') AND try_cast(trim(v) AS BIGINT) IS NOT NULL) AS i,
 count(*) FILTER (regexp_full_match(v, '\s*[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)?(\.[0-9]*)?\s*') AND regexp_matches(v, '[0-9]')) AS d, count(*) FILTER (regexp_matches(v, '^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') AND try_cast(v AS TIMESTAMP) IS NOT NULL) AS t,
 count(*) FILTER (regexp_full_match(v, '[{(]?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}[)}]?')) AS g, count(*) FILTER (regexp_full_match(v, '[^@\s]+@[^@\s]+\.[^@\s]+')) AS e, count(*) FILTER (regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*:\S+$')) AS u,
 count(*) FILTER ((v[1] = '{' AND v[-1] = '}') OR (v[1] = '[' AND v[-1] = ']')) AS j FROM v GROUP BY 1),
s AS (SELECT *, greatest(b, i, d, t, g, e, u, j) AS best FROM c)
SELECT col AS "column", CASE WHEN filled = 0 OR best < filled * 0.5 THEN 'String' ELSE CASE best WHEN b THEN 'Boolean' WHEN i THEN 'Integer' WHEN d THEN 'Decimal' WHEN t THEN 'DateTime' WHEN g THEN 'Guid' WHEN e THEN 'Email' WHEN u THEN 'Url' ELSE 'Json' END END AS inferred,
 filled < total AS nullable, total - filled AS nulls, CASE WHEN filled = 0 THEN 0.0 WHEN best < filled * 0.5 THEN 1.0 ELSE best / filled::DOUBLE END::DOUBLE AS confidence FROM s""")
def infer_schema(t: Tables):
    return ql.infer_schema(_mixed(t))


@query("inferred_statistics", "I3", """
SELECT 'event_id' AS "column", 'Integer' AS inferred, count(DISTINCT event_id) AS "unique", min(event_id)::DOUBLE AS lo, max(event_id)::DOUBLE AS hi, round(avg(event_id), 4) AS mean, median(event_id)::DOUBLE AS median, NULL::INTEGER AS min_len, NULL::INTEGER AS max_len FROM events
UNION ALL SELECT 'value', 'Decimal', count(DISTINCT value), min(value), max(value), round(avg(value), 4), median(value), NULL, NULL FROM events
UNION ALL SELECT 'event_type', 'String', count(DISTINCT event_type), NULL, NULL, NULL, NULL, min(length(event_type)), max(length(event_type)) FROM events
UNION ALL SELECT 'mail', 'Email', count(DISTINCT mail), NULL, NULL, NULL, NULL, min(length(mail)), max(length(mail)) FROM (SELECT CASE WHEN value > 50 THEN event_type || '@x.org' END AS mail FROM events)
UNION ALL SELECT 'at', 'DateTime', count(DISTINCT ts), NULL, NULL, NULL, NULL, NULL, NULL FROM events
UNION ALL SELECT 'props', 'Json', count(DISTINCT props), NULL, NULL, NULL, NULL, NULL, NULL FROM events
UNION ALL SELECT 'flag', 'Boolean', count(DISTINCT user_id % 2), NULL, NULL, NULL, NULL, NULL, NULL FROM events""", wide=True)
def inferred_statistics(t: Tables):
    raw = _mixed(t)
    return ql.inferred_statistics(raw, ql.infer_schema(raw)).withColumn("mean", F.round("mean", 4))


@query("apply_schema", "I4", """
SELECT event_id, value, (epoch(ts) * 0 + day(ts))::INTEGER AS day, CASE WHEN event_type = 'view' THEN NULL ELSE event_id END AS maybe, CASE WHEN event_type = 'view' THEN 'view' END AS rejected FROM events""")
def apply_schema(t: Tables):
    raw = _raw(t.events.select("event_id", "value", F.col("ts").alias("at"), F.when(F.col("event_type") == "view", "view").otherwise(F.col("event_id").cast("string")).alias("maybe")))
    typed = ql.apply_schema(raw, {"event_id": "Integer", "value": "Decimal", "at": "DateTime", "maybe": "Integer"})
    return typed.select("event_id", F.col("value").cast("double").alias("value"), F.dayofmonth("at").alias("day"), "maybe", F.col("_rejected")["maybe"].alias("rejected"))


# the same moments written in several ways; DuckDB's name of each form
_FORMS = {"M/d/yyyy": "%-m/%-d/%Y", "d/M/yyyy": "%-d/%-m/%Y", "d.M.yyyy": "%-d.%-m.%Y", "M-d-yyyy": "%-m-%-d-%Y", "d-M-yyyy": "%-d-%-m-%Y",
          "yyyy/M/d": "%Y/%-m/%-d", "d MMM yyyy": "%-d %b %Y", "MMM d, yyyy": "%b %-d, %Y", "d MMMM yyyy": "%-d %B %Y", "MMMM d, yyyy": "%B %-d, %Y"}
_WRITTEN = {"us": "M/d/yyyy", "eu": "d/M/yyyy", "dots": "d.M.yyyy", "dashes": "d-M-yyyy", "slashes": "yyyy/M/d", "names": "d MMM yyyy", "long_names": "MMMM d, yyyy", "either": "M/d/yyyy"}
_TIMED = "CASE WHEN event_id % 2 = 0 THEN strftime(ts, ' %H:%M:%S') ELSE '' END"
_WRITTEN_SQL = "w AS (SELECT event_id, ts, event_type, " + ", ".join(
    f"CASE WHEN event_type <> 'error' AND {'day(ts) <= 12' if c == 'either' else 'true'} THEN strftime(ts, '{_FORMS[f]}') || {_TIMED} END AS {c}" for c, f in _WRITTEN.items()) + " FROM events)"


def _written(t: Tables):
    """Events' times in eight text columns, some with hours; the last has no day above twelve."""
    hours = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", " HH:mm:ss")).otherwise("")
    kept = F.col("event_type") != "error"
    return t.events.select("event_id", *[F.when(kept & ((F.dayofmonth("ts") <= 12) if c == "either" else F.lit(True)), F.concat(F.date_format("ts", f), hours)).alias(c) for c, f in _WRITTEN.items()])


@query("infer_dates", "I1 I2", f"WITH {_WRITTEN_SQL}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, [" + ", ".join(f"count(try_strptime({c}, ['{d} %H:%M:%S', '{d}']))" for d in _FORMS.values()) + "] AS n FROM w" for c in _WRITTEN)
    + f") SELECT \"column\", {list(_FORMS)}[list_position(n, list_max(n))] AS form, list_max(n) AS parsed, filled, len(list_filter(n, lambda x: x = list_max(n))) > 1 AND \"column\" NOT LIKE '%names' AS ambiguous FROM c")
def infer_dates(t: Tables):
    return ql.infer_dates(_written(t).drop("event_id"))


@query("apply_date_forms", "I2 I4", "SELECT event_id, " + ", ".join(
    f"CASE WHEN event_type <> 'error' AND {'day(ts) <= 12' if c == 'either' else 'true'} THEN epoch(CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END)::BIGINT END AS {c}" for c in _WRITTEN) + ", 0 AS rejected FROM events", wide=True)
def apply_date_forms(t: Tables):
    raw = _written(t)
    forms = {r["column"]: r["form"] for r in ql.infer_dates(raw.drop("event_id")).collect()}  # one row per column
    typed = ql.apply_schema(raw, dict.fromkeys(forms, "DateTime"), dates=forms)
    return typed.select("event_id", *[F.unix_timestamp(F.col(c).cast("timestamp")).alias(c) for c in forms], F.coalesce(F.size("_rejected"), F.lit(0)).alias("rejected"))


@query("map_schemas", "I5 X4", """
WITH s(col, ty) AS (VALUES ('doc_id', 'Integer'), ('text', 'String')), g(i, target, ty) AS (VALUES (0, 'item_id', 'Integer'), (1, 'text', 'String')),
p AS (SELECT s.col, target, i, 0.7 * (1 - levenshtein(col, target)::DOUBLE / greatest(length(col), length(target))) + 0.3 * CASE WHEN s.ty = g.ty THEN 1 ELSE 0.5 END AS score FROM s, g)
SELECT col AS "column", target, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY col ORDER BY score DESC, i) = 1""")
def map_schemas(t: Tables):
    # types on both sides are inferred from all values of the two tables
    src = ql.infer_schema(_raw(t.documents.select("doc_id", "text")))
    dst = [(r["column"], r["inferred"]) for r in ql.infer_schema(_raw(t.benchmark)).collect()]  # one row per column
    order = {c: i for i, c in enumerate(t.benchmark.columns)}
    return ql.map_schemas(src, sorted(dst, key=lambda x: order[x[0]])).withColumn("score", F.round("score", 6))


@query("schema_history", "I6 S11")
def schema_history(t: Tables):
    out = None
    for name in TABLE_NAMES:
        df = getattr(t, name)
        d = ql.schema_rows(df).select(F.lit(name).alias("table_name"), F.lit(1).alias("version"), F.lit(ql.schema_hash(df)).alias("hash"), "ordinal", "name", "type", "nullable", "max_length")
        out = d if out is None else out.unionByName(d)
    return out


@query("schema_drift", "I7", """
WITH lo AS (UNPIVOT (SELECT max(length(o_orderstatus)) AS o_orderstatus, max(length(o_orderpriority)) AS o_orderpriority FROM orders) ON * INTO NAME name VALUE len),
ln AS (UNPIVOT (SELECT max(length(o_orderstatus)) AS o_orderstatus, max(length(left(o_orderpriority, 8))) AS o_orderpriority, max(length(o_custkey::VARCHAR)) AS o_custkey, 3::BIGINT AS o_shipmode FROM orders) ON * INTO NAME name VALUE len),
o AS (SELECT column_name AS name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS ty FROM (DESCRIBE SELECT * FROM orders)),
n AS (SELECT column_name AS name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS ty FROM (DESCRIBE SELECT * EXCLUDE (o_orderdate) REPLACE (o_custkey::VARCHAR AS o_custkey, left(o_orderpriority, 8) AS o_orderpriority), 'AIR' AS o_shipmode FROM orders))
SELECT * FROM (SELECT name, CASE WHEN o.ty IS NULL THEN 'added' WHEN n.ty IS NULL THEN 'removed' WHEN o.ty <> n.ty OR lo.len IS DISTINCT FROM ln.len THEN 'modified' END AS change, o.ty AS old_type, n.ty AS new_type
 FROM o FULL JOIN n USING (name) LEFT JOIN lo USING (name) LEFT JOIN ln USING (name)) WHERE change IS NOT NULL""")
def schema_drift(t: Tables):
    new = t.orders.drop("o_orderdate").withColumns({"o_shipmode": F.lit("AIR"), "o_custkey": F.col("o_custkey").cast("string"), "o_orderpriority": F.left("o_orderpriority", F.lit(8))})
    nullable = t.spark.createDataFrame([], new.schema)  # keeps every field nullable on both sides
    return ql.schema_drift(ql.schema_rows(t.orders), ql.schema_rows(nullable.unionByName(new)))
