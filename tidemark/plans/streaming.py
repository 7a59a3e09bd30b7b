"""Streaming queries: each runs over all input and is compared with batch SQL."""

from pyspark.sql import functions as F

from tidemark.functions import privacy
from tidemark.plans.registry import query
from tidemark.session import Tables, scratch_path
from tidemark.sources.keyed_table import KeyedTable
from tidemark.streaming import streams as st

MAX = "(SELECT max(ts) FROM events)"


def _events(t: Tables):
    """The events table as a stream with an instant time column."""
    return st.read_stream(t.spark, t.path("events"), t.events.schema).withColumn("at", F.col("ts").cast("timestamp"))


def _in_turn(t: Tables, parts, label, consume):
    """Frames arrive one after the other, in files of all their tasks; ``consume`` runs
    the stream over each arrival, as a restart of the same checkpoint does."""
    path, out = scratch_path(t.spark, label), None
    for p in parts:
        p.write.mode("append").parquet(path)
        out = consume(st.read_stream(t.spark, path, parts[0].schema))
    return out


def _landed_in_turn(t: Tables, parts, label, step):
    """``step`` of the arriving rows, landed through one checkpoint."""
    path, checkpoint = scratch_path(t.spark, label), scratch_path(t.spark, f"{label}-checkpoint")
    return _in_turn(t, parts, f"{label}-input", lambda s: st.land(step(s), label, path=path, checkpoint=checkpoint))


@query("stream_from_earliest", "ST1", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_from_earliest(t: Tables):
    return st.land(_events(t), "earliest").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_messages", "ST2", "SELECT user_id::VARCHAR AS key, event_id, value FROM events")
def stream_messages(t: Tables):
    topic = st.land(st.as_messages(_events(t).drop("at"), "user_id"), "messages")
    v = F.from_json("value", "event_id bigint, value double")
    return topic.select("key", v.alias("v")).select("key", "v.event_id", "v.value")


@query("stream_replay", "ST3", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_replay(t: Tables):
    out, checkpoint = scratch_path(t.spark, "replay"), scratch_path(t.spark, "replay-checkpoint")
    e = t.events.select("event_id", "event_type", "ts")
    first, second = e.where("event_type <> 'view'"), e.where("event_type = 'view'")
    src = scratch_path(t.spark, "replay-source")
    for part in (first, second):
        # a restart of the same checkpoint picks up only the new files
        part.write.mode("append").parquet(src)
        st.each_batch(st.read_stream(t.spark, src, e.schema), st.replayable_sink(out), checkpoint)
    st.each_batch(st.read_stream(t.spark, src, e.schema), st.replayable_sink(out), checkpoint)
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_LAST = "SELECT user_id AS k, arg_max(value, event_id) AS v, arg_max(event_type = 'error', event_id) AS gone FROM events GROUP BY 1"


def _changes(t: Tables):
    """Events as changes of customers' balances, in three arrivals by time."""
    op = F.when(F.col("event_type") == "error", "D").otherwise("I")
    ch = t.events.select(F.col("event_id").alias("change_id"), F.col("user_id").alias("k"), F.col("value").alias("v"), op.alias("op"), "ts")
    cuts = [F.lit(c).cast("timestamp_ntz") for c in ("2024-01-11", "2024-01-21")]
    return [ch.where(F.col("ts") < cuts[0]), ch.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), ch.where(F.col("ts") >= cuts[1])]


def _merged(t: Tables) -> KeyedTable:
    table = KeyedTable(t.spark, scratch_path(t.spark, "merged"), ["k"])
    table.create(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")))
    checkpoint = scratch_path(t.spark, "merge-checkpoint")
    _in_turn(t, _changes(t), "changes", lambda s: st.each_batch(s, st.merge_sink(table), checkpoint))
    return table


@query("stream_merge", "ST4", f"""
WITH l AS ({_LAST}) SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM l) UNION ALL SELECT k, v FROM l WHERE NOT gone""")
def stream_merge(t: Tables):
    return _merged(t).read()


@query("stream_change_feed", "C11 ST4", """
WITH e AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch, user_id AS k, value AS v, event_type, event_id FROM events),
l AS (SELECT batch, k, arg_max(event_type = 'error', event_id) AS gone, arg_max(v, event_id) AS v FROM e GROUP BY 1, 2
 UNION ALL SELECT -1, c_custkey, false, c_acctbal FROM customer),
h AS (SELECT *, coalesce(NOT lag(gone) OVER w, false) AS had, lag(v) OVER w AS was FROM l WINDOW w AS (PARTITION BY k ORDER BY batch))
SELECT batch::BIGINT AS batch, CASE WHEN gone THEN 'D' WHEN had THEN 'U' ELSE 'I' END AS op, k, CASE WHEN gone THEN was ELSE v END AS v
FROM h WHERE batch >= 0 AND CASE WHEN gone THEN had ELSE NOT had OR v <> was END""")
def stream_change_feed(t: Tables):
    return _merged(t).feed()


@query("stream_statistics", "ST5", "SELECT event_type, count(*) AS length, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY 1")
def stream_statistics(t: Tables):
    topic = st.land(_events(t), "statistics").withColumn("pos", F.struct("ts", "event_id"))
    return st.stream_statistics(topic, "event_type", "pos", "event_id")


@query("stream_trim", "ST6", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def stream_trim(t: Tables):
    return st.trim(st.land(_events(t), "trim"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id")


@query("stream_tumbling", "ST7 T6", f"""
SELECT event_type, strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS total
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events) GROUP BY 1, w HAVING w + INTERVAL 1 HOUR <= {MAX} - INTERVAL 2 HOUR""")
def stream_tumbling(t: Tables):
    s = st.windowed(_events(t), "at", "2 hours", "1 hour", None, ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum(F.col("value").cast("decimal(18,2)"))})
    return st.land(s, "tumbling").select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("stream_sliding", "ST7", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES * k AS w FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
GROUP BY w HAVING w + INTERVAL 2 HOUR <= {MAX} - INTERVAL 2 HOUR""")
def stream_sliding(t: Tables):
    s = st.windowed(_events(t), "at", "2 hours", "2 hours", "30 minutes", [], {"n": F.count(F.lit(1))})
    return st.land(s, "sliding").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


_SESSIONS = """
WITH f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f),
g AS (SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY 1, 2)"""


@query("session_windows", "ST8", _SESSIONS + " SELECT user_id, session::BIGINT AS session, epoch_us(first_ts) AS start_us, epoch_us(last_ts) AS last_us, n FROM g")
def session_windows(t: Tables):
    d = st.sessionize(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", ["ts", "event_id"], 6 * 3600, {"n": F.count(F.lit(1))})
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return d.select("user_id", "session", us("start").alias("start_us"), us("last").alias("last_us"), "n")


@query("stream_session_windows", "ST8", _SESSIONS + f" SELECT user_id, epoch_us(first_ts) AS start_us, n FROM g WHERE last_ts + INTERVAL 6 HOUR <= {MAX} - INTERVAL 1 HOUR")
def stream_session_windows(t: Tables):
    s = st.session_windows(_events(t), "at", "1 hour", "6 hours", ["user_id"], {"n": F.count(F.lit(1))})
    return st.land(s, "sessions").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("stream_dedup", "ST9", "SELECT event_id, value FROM events")
def stream_dedup(t: Tables):
    e = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    twice = [e, e.where("event_type <> 'click'")]
    return _landed_in_turn(t, twice, "dedup", lambda s: st.dedup_stream(s, ["event_id"], "at", "40 days")).select("event_id", "value")


@query("stream_late_data", "ST10", """
SELECT event_id, CASE WHEN event_type = 'signup' AND ts < (SELECT max(ts) FROM events WHERE event_type <> 'signup') - INTERVAL 1 DAY THEN 'late' ELSE 'on_time' END AS route FROM events""")
def stream_late_data(t: Tables):
    out, checkpoint = scratch_path(t.spark, "late"), scratch_path(t.spark, "late-checkpoint")
    parts = [t.events.where("event_type <> 'signup'"), t.events.where("event_type = 'signup'")]
    _in_turn(t, parts, "arrivals", lambda s: st.each_batch(s, st.route_late(out, "ts", 86400), checkpoint))
    return t.spark.read.parquet(f"{out}/rows").select("event_id", "route")


@query("stream_spikes", "ST11", """
WITH w AS (SELECT *, avg(value) OVER h AS m, stddev_samp(value) OVER h AS s FROM events WINDOW h AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
SELECT event_id, coalesce(s > 0 AND abs(value - m) / s > 1.959963985, false) AS is_spike FROM w""")
def stream_spikes(t: Tables):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    e = t.events.select("event_id", "user_id", "ts", "value")
    out, checkpoint = scratch_path(t.spark, "spikes"), scratch_path(t.spark, "spikes-checkpoint")
    order = ["ts", "event_id"]
    tails = st.spike_tails(t.spark, scratch_path(t.spark, "spike-tails"), e.schema, ["user_id"], order)
    sink = st.spike_sink(out, tails, order, "value", ["event_id"])
    _in_turn(t, [e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)], "spike-input", lambda s: st.each_batch(s, sink, checkpoint))
    return t.spark.read.parquet(out).select("event_id", "is_spike")


@query("stream_enrichment", "ST12", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_enrichment(t: Tables):
    static = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return st.land(_events(t).join(static, "user_id").select("event_id", "c_mktsegment"), "enriched")


@query("stream_interval_join", "ST12", """
SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def stream_interval_join(t: Tables):
    v = _events(t).where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("view_at"))
    p = _events(t).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("at").alias("purchase_at"))
    return st.land(st.interval_join(v, p, "user_id", "view_at", "purchase_at", "1 hour", 2).select("view_id", "purchase_id"), "interval")


def _masked_sql() -> str:
    out = "text"
    for n, p in privacy.PATTERNS.items():
        out = f"regexp_replace({out}, '{p}', '[{n}]', 'g')"
    return out


@query("stream_mask_validate", "ST13", f"SELECT doc_id, md5({_masked_sql()}) AS masked, length(text) BETWEEN 20 AND 5000 AS valid FROM documents")
def stream_mask_validate(t: Tables):
    docs = st.read_stream(t.spark, t.path("documents"), t.documents.schema)
    s = docs.select("doc_id", F.md5(privacy.mask_pii(F.col("text"), "redact")).alias("masked"), F.length("text").between(20, 5000).alias("valid"))
    return st.land(s, "masked")
