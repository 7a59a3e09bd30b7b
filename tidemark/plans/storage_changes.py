"""Source, sink, change-data and snapshot queries."""

from pyspark.sql import functions as F

from tidemark.operators import cdc
from tidemark.plans.registry import query
from tidemark.session import TABLE_NAMES, Tables, scratch_path
from tidemark.sources import files as fs
from tidemark.sources.snapshots import SnapshotTable

ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _orders(t: Tables):
    return t.orders.select(*ORD)


@query("catalog_sql", "S3 S4", """
SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1000""")
def catalog_sql(t: Tables):
    fs.register_tables(t.spark, t.root, ["customer", "nation"])
    out, _ = fs.run_sql(t.spark, "SELECT c_mktsegment, n_name, count(1) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY 1, 2")
    return out


@query("sql_truncation", "S4", "SELECT o_orderkey, count(*) OVER () > 120 AS truncated FROM orders ORDER BY o_orderkey LIMIT 120")
def sql_truncation(t: Tables):
    fs.register_tables(t.spark, t.root, ["orders"])
    out, truncated = fs.run_sql(t.spark, "SELECT o_orderkey FROM orders ORDER BY o_orderkey", 120)
    return out.withColumn("truncated", F.lit(truncated))


@query("table_preview", "S5", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 100")
def table_preview(t: Tables):
    return fs.preview(t.supplier, ["s_suppkey"])


@query("table_inventory", "S6")
def table_inventory(t: Tables):
    return fs.table_inventory(t.spark, t.root)


@query("storage_metrics", "S23")
def storage_metrics(t: Tables):
    return fs.storage_metrics(fs.file_listing(t.spark, t.root, "*.parquet"))


_BACK = "SELECT '{f}' AS fmt, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM orders"
_FORMATS = [("parquet", c) for c in ("snappy", "gzip", "zstd", "lz4", "none")] + [("csv", ""), ("json", ""), ("orc", "")]


@query("sink_formats", "S7 S8 S9 S19", " UNION ALL ".join(_BACK.format(f=f + c) for f, c in _FORMATS))
def sink_formats(t: Tables):
    out = None
    for f, c in _FORMATS:
        path = fs.export_table(_orders(t), scratch_path(t.spark, "export"), f, compression=c or "snappy")
        d = fs.load_files(_orders(t).schema, t.spark, path, f)
        d = d.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
        d = d.select(F.lit(f + c).alias("fmt"), "n", "total")
        out = d if out is None else out.unionByName(d)
    return out


@query("schema_export", "S11", """
SELECT (row_number() OVER () - 1)::INTEGER AS ordinal, column_name AS name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type
FROM (DESCRIBE SELECT * FROM region)""")
def schema_export(t: Tables):
    from tidemark.operators.quality import schema_rows

    path = scratch_path(t.spark, "schema")
    schema_rows(t.region).write.json(path)
    return t.spark.read.schema("ordinal int, name string, type string").json(path)


@query("partitioned_write", "S12 S22", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-05-31'""")
def partitioned_write(t: Tables):
    path = scratch_path(t.spark, "partitioned")
    df = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    # one writer per month directory, spread further by key so no month is a single task
    fs.export_table(df.repartition("month", F.pmod(F.xxhash64("o_orderkey"), F.lit(4))), path, partition_by=["month"])
    d = fs.partition_range(t.spark.read.parquet(path), "month", "1997-03", "1997-05")
    return d.where(F.col("day").between("1997-03-01", "1997-05-31")).select(F.col("day").cast("string").alias("day"), "o_orderkey")


_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
         "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "events": ["event_id"]}


@query("sync_tables", "S13", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, true AS ok, count(*) AS source_rows, {r} AS rows FROM {n}" for n, r in
    [("nation", "count(*)"), ("customer", "least(300, count(*))"), ("events", "least(500, count(*))"), ("orders", "CASE WHEN count(*) <= 100 THEN count(*) ELSE (SELECT sum(ceil(399.0::DOUBLE * c / n))::BIGINT FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS n FROM orders GROUP BY o_orderstatus)) END")]))
def sync_tables(t: Tables):
    d = fs.sync_tables(t.spark, t.root, scratch_path(t.spark, "sync"), keys=_KEYS, include=["NATION", "customer", "orders", "Events", "part"], skip=["Part"],
                       options={"n": 300, "max_full_rows": 100}, overrides={"events": {"strategy": "recent", "n": 500}, "orders": {"strategy": "stratified", "stratify_col": "o_orderstatus", "n": 399}})
    return d.select("table_name", "ok", "source_rows", "rows")


@query("sync_sources", "S14", """
SELECT 'a' AS source, 'supplier' AS table_name, count(*) AS source_rows, least(50, count(*)) AS rows FROM supplier UNION ALL SELECT 'b', 'supplier', count(*), least(20, count(*)) FROM supplier
UNION ALL SELECT 'b', 'part', count(*), least(20, count(*)) FROM part""")
def sync_sources(t: Tables):
    d = fs.sync_sources(t.spark, {"a": {"source": t.root, "tables": ["supplier"], "options": {"n": 50, "max_full_rows": 5}},
                                  "b": {"source": t.root, "include": ["supplier", "part"], "options": {"n": 20, "max_full_rows": 5}}}, scratch_path(t.spark, "sources"), keys=_KEYS)
    return d.select("source", "table_name", "source_rows", "rows")


@query("sync_estimate", "S15", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS source_rows, CASE WHEN count(*) <= 5000 THEN count(*) ELSE 2000 END AS estimated_rows, greatest(1.0, CASE WHEN count(*) <= 5000 THEN count(*) ELSE 2000 END / 10000.0)::DOUBLE AS estimated_seconds FROM {n}"
    for n in ("orders", "lineitem", "customer")))
def sync_estimate(t: Tables):
    d = fs.sync_estimate(t.spark, t.root, n=2000, max_full_rows=5000, tables=["orders", "lineitem", "customer"])
    return d.select("table_name", "source_rows", "estimated_rows", "estimated_seconds")


@query("copy_into", "S18", """
SELECT 'first' AS load, 1::BIGINT AS files, count(*) AS loaded, 0::BIGINT AS rejected FROM supplier UNION ALL SELECT 'again', 0, 0, 0 UNION ALL SELECT 'table', NULL, count(*), NULL FROM supplier""")
def copy_into(t: Tables):
    src, table = scratch_path(t.spark, "copy-src"), scratch_path(t.spark, "copy-table")
    fs.export_table(t.supplier, src, "csv", single_file=True)
    opts = {"pathGlobFilter": "*.csv"}
    first = _copy(t, table, src, opts)
    again = _copy(t, table, src, opts)
    loaded = fs.read_loaded(t.spark, table).agg(F.count(F.lit(1)).alias("loaded"))
    rows = t.spark.createDataFrame([("first", *first.values()), ("again", *again.values())], "load string, files long, loaded long, rejected long")
    null = F.lit(None).cast("long")
    return rows.unionByName(loaded.select(F.lit("table").alias("load"), null.alias("files"), "loaded", null.alias("rejected")))


def _copy(t: Tables, table: str, src: str, opts):
    return fs.copy_into(t.spark, table, f"{src}/*.csv", t.supplier.schema, max_errors=10)


@query("unload_query", "S20", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def unload_query(t: Tables):
    t.orders.createOrReplaceTempView("tm_unload")
    return t.spark.read.parquet(fs.unload(t.spark, "SELECT o_custkey, count(1) AS n FROM tm_unload GROUP BY 1", scratch_path(t.spark, "unload")))


@query("external_table", "S21", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def external_table(t: Tables):
    fs.external_view(t.spark, "tm_external_part", t.path("part"))
    return t.spark.sql("SELECT p_brand, count(1) AS n FROM tm_external_part GROUP BY 1")


@query("document_find", "S24 X6", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 50 ORDER BY event_id LIMIT 1000")
def document_find(t: Tables):
    path = scratch_path(t.spark, "documents")
    t.events.select("event_id", F.from_json("props", "struct<k:bigint>").alias("props")).write.json(path)
    docs = t.spark.read.schema("event_id bigint, props struct<k:bigint>").json(path)
    return fs.find_documents(docs, F.col("props.k") >= 50, ["event_id"]).select("event_id", F.col("props.k").alias("k"))


@query("document_upsert", "S25 C5", """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 5000""")
def document_upsert(t: Tables):
    c = t.customer
    incoming = c.where("c_acctbal > 5000").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return cdc.merge(c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_acctbal"), incoming, ["c_custkey"])


@query("codec_advice", "S26", """
WITH c AS (SELECT unnest(string_split(p_partkey || '|' || p_name || '|' || p_brand || '|' || p_type || '|' || p_size || '|' || p_retailprice, '')) AS ch FROM part),
n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS size, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 8 AS entropy FROM n)
SELECT size, round(entropy, 6) AS entropy, 0.5::DOUBLE AS text_share, 0.5::DOUBLE AS numeric_share, CASE WHEN entropy > 0.9 THEN 'none' WHEN size / 1048576.0 < 100 THEN 'lz4' ELSE 'zstd' END AS codec,
 round(CASE WHEN entropy > 0.9 THEN 1.0 WHEN size / 1048576.0 < 100 THEN 0.45 + entropy * 0.55 ELSE 0.3 + entropy * 0.7 END, 6) AS expected_ratio FROM s""")
def codec_advice(t: Tables):
    return fs.codec_advice(t.part).withColumns({"entropy": F.round("entropy", 6), "expected_ratio": F.round("expected_ratio", 6)})


@query("changes_since_timestamp", "C1", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def changes_since_timestamp(t: Tables):
    return cdc.detect_since(t.events, "ts", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


# Changes derived from events: user rows keyed by user_id, change id = event_id.
_CH = "SELECT event_id AS change_id, user_id AS k, value AS v, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op FROM events"


def _changes(t: Tables):
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    return t.events.select(F.col("event_id").alias("change_id"), F.col("user_id").alias("k"), F.col("value").alias("v"), op.alias("op"))


@query("changes_since_version", "C2", f"SELECT k, arg_max(op, change_id) AS op, arg_max(v, change_id) AS v, max(change_id) AS change_id FROM ({_CH}) WHERE change_id > 500 GROUP BY 1")
def changes_since_version(t: Tables):
    return cdc.latest_changes(cdc.detect_since(_changes(t), "change_id", 500), ["k"], "change_id")


_NEW = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0
 UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P')"""


def _new_orders(t: Tables):
    o = _orders(t)
    changed = o.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    return changed.unionByName(o.where("o_orderstatus = 'P'").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))


_DIFF = f"""SELECT CASE WHEN a.o_orderkey IS NULL THEN 'I' WHEN b.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS op, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice
FROM orders a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice"""


@query("changes_full_compare", "C3", _DIFF)
def changes_full_compare(t: Tables):
    return cdc.diff(_orders(t), _new_orders(t), ["o_orderkey"]).select("op", "o_orderkey", "o_totalprice")


_LAST = f"SELECT k, arg_max(op, change_id) AS op, arg_max(v, change_id) AS v FROM ({_CH}) GROUP BY 1"
_BASE = "(SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'MACHINERY')"


@query("apply_changes", "C4", f"""
WITH l AS ({_LAST}), g AS (SELECT l.* FROM l LEFT JOIN {_BASE} b ON b.k = l.k WHERE l.op = 'I' OR b.k IS NOT NULL)
SELECT k, v FROM {_BASE} WHERE k NOT IN (SELECT k FROM g) UNION ALL SELECT k, v FROM g WHERE op <> 'D'""")
def apply_changes(t: Tables):
    return cdc.apply_changes(_base(t), _changes(t), ["k"])[0]


def _base(t: Tables):
    return t.customer.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


@query("apply_changes_counts", "C4", f"""
SELECT l.op, CASE WHEN l.op <> 'I' AND b.k IS NULL THEN 'failed' ELSE 'applied' END AS outcome, count(*) AS n FROM ({_LAST}) l LEFT JOIN {_BASE} b ON b.k = l.k GROUP BY 1, 2""")
def apply_changes_counts(t: Tables):
    return cdc.apply_changes(_base(t), _changes(t), ["k"])[1]


@query("merge_with_delete", "C6", f"""
WITH l AS ({_LAST}) SELECT coalesce(b.k, l.k) AS k, CASE WHEN b.k IS NULL THEN l.v WHEN l.k IS NOT NULL AND l.v > 20 THEN l.v ELSE b.v END AS v FROM {_BASE} b FULL JOIN l ON b.k = l.k WHERE coalesce(l.op, '') <> 'D'""")
def merge_with_delete(t: Tables):
    src = cdc.latest_changes(_changes(t), ["k"], "change_id").withColumn("action", F.when(F.col("op") == "D", "DELETE").otherwise("UPSERT"))
    return cdc.merge(_base(t), src, ["k"], action="action", when=F.col("s.v") > 20)


@query("update_delete_where", "C7", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_totalprice < 10000)""")
def update_delete_where(t: Tables):
    d = cdc.update_where(_orders(t), F.col("o_totalprice") > 200000, {"o_orderstatus": F.lit("X")})
    return cdc.delete_where(d, F.col("o_totalprice") < 10000).select("o_orderkey", "o_orderstatus")


@query("high_water_marks", "C8", """
SELECT event_type AS table_name, max(event_id) AS mark, strftime(max(ts), '%Y-%m-%d') AS day FROM events GROUP BY 1""")
def high_water_marks(t: Tables):
    log = t.events.select(F.col("event_type").alias("table_name"), F.col("event_id").alias("mark"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return cdc.latest_state(log, "table_name", "mark")


def _store(t: Tables) -> SnapshotTable:
    s = SnapshotTable(t.spark, scratch_path(t.spark, "snapshots"))
    s.write(_orders(t), comment="base")
    s.write(_new_orders(t), comment="changed")
    return s


_SUM = "count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total"


def _sums(df, label):
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total")).select(F.lit(label).alias("step"), "n", "total")


@query("snapshot_lifecycle", "C9 C10 C12 C13 S2 S10", f"""
SELECT 'latest' AS step, {_SUM} FROM {_NEW} UNION ALL SELECT 'version 1', {_SUM} FROM orders UNION ALL SELECT 'as of 1', {_SUM} FROM orders UNION ALL SELECT 'restored', {_SUM} FROM orders
UNION ALL SELECT 'clone', {_SUM} FROM orders UNION ALL SELECT 'optimized', {_SUM} FROM orders""")
def snapshot_lifecycle(t: Tables):
    s = _store(t)
    at = s.log().where("version = 1").first().committed_at
    parts = [_sums(s.read(), "latest"), _sums(s.read(1), "version 1"), _sums(s.read(as_of=at), "as of 1")]
    s.restore(1)
    parts.append(_sums(s.read(), "restored"))
    parts.append(_sums(s.clone_to(scratch_path(t.spark, "clone")).read(), "clone"))
    s.optimize(["o_orderkey"], 4)
    parts.append(_sums(s.read(), "optimized"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("snapshot_history", "C9 C10", f"""
SELECT 4::BIGINT AS version, 'optimize' AS operation, count(*) AS rows FROM {_NEW} UNION ALL SELECT 2, 'write', count(*) FROM {_NEW}""")
def snapshot_history(t: Tables):
    s = _store(t)
    s.delete(1)  # the tombstone itself is commit 3
    s.optimize(["o_custkey"], 2)
    s.prune(2)
    return s.history().select("version", "operation", "rows")


@query("snapshot_change_feed", "C11", f"SELECT 2 AS version, op, o_orderkey, o_totalprice FROM ({_DIFF})")
def snapshot_change_feed(t: Tables):
    return _store(t).change_feed(["o_orderkey"], 1).select("version", "op", "o_orderkey", "o_totalprice")


@query("retention", "C14", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 15 DAY")
def retention(t: Tables):
    return cdc.retain(t.events, "ts", 15, "2024-01-25").select("event_id")


@query("sync_history", "C15 L1", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def sync_history(t: Tables):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id")
