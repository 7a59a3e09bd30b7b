"""Time-series and geospatial queries."""

from pyspark.sql import functions as F

from tidemark.operators import geo
from tidemark.operators import timeseries as ts
from tidemark.plans.registry import query
from tidemark.session import Tables

ORDER = ["ts", "event_id"]
IDX = "SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events"


def _series(t: Tables):
    return t.events.select("user_id", "ts", "event_id", "value")


@query("series_trend", "T1", f"""
SELECT user_id, round(regr_slope(value, i), 6) AS slope, round(regr_intercept(value, i), 4) AS intercept,
 CASE WHEN regr_slope(value, i) > 0 THEN 'Increasing' WHEN regr_slope(value, i) < 0 THEN 'Decreasing' ELSE 'Stable' END AS direction FROM ({IDX}) GROUP BY 1""")
def series_trend(t: Tables):
    return ts.trend(_series(t), ["user_id"], ORDER, "value").withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4)})


_AC = f"""
WITH s AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS d, event_id, ts FROM events),
p AS (SELECT user_id, d, lead(d, 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d7 FROM s),
a AS (SELECT user_id, count(*) AS n, coalesce(sum(d * d7), 0) / sum(d * d) AS r FROM p GROUP BY 1)"""


@query("series_autocorrelation", "T2", _AC + " SELECT user_id, n, round(r, 6) AS r FROM a")
def series_autocorrelation(t: Tables):
    return ts.autocorrelation(_series(t), ["user_id"], ORDER, "value", 7).withColumn("r", F.round("r", 6))


@query("series_seasonality", "T3", _AC + " SELECT user_id, n >= 14 AND abs(r) > 0.5 AS seasonal, 7 AS period, round(CASE WHEN n >= 14 THEN abs(r) ELSE 0 END, 6) AS strength FROM a")
def series_seasonality(t: Tables):
    return ts.seasonality(_series(t), ["user_id"], ORDER, "value", 7).withColumn("strength", F.round("strength", 6))


@query("series_naive_forecast", "T4", """
WITH r AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events),
g AS (SELECT user_id, epoch_us(max(ts)) AS hi, CASE WHEN count(*) = 1 THEN 86400000000 ELSE epoch_us(max(ts)) - epoch_us(min(ts)) END AS step_us, arg_max(value, ts) AS forecast FROM r WHERE k <= 2 GROUP BY 1)
SELECT user_id, step, hi + step_us * step AS at_us, forecast FROM g, (SELECT unnest(range(1, 31)) AS step)""", wide=True)
def series_naive_forecast(t: Tables):
    d = ts.naive_forecast(_series(t), ["user_id"], "ts", "value", 30)
    return d.select("user_id", "step", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "forecast")


@query("series_statistics", "T5", """
SELECT event_type, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS var, round(stddev_pop(value), 4) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1""")
def series_statistics(t: Tables):
    return ts.series_statistics(t.events, ["event_type"], "value").withColumns({c: F.round(c, 4) for c in ("mean", "var", "sd")})


@query("series_downsample", "T6 X10", """
SELECT event_type, strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS total, min(value) AS lo, max(value) AS hi FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1, 2""")
def series_downsample(t: Tables):
    v = F.col("value")
    aggs = {"n": F.count(F.lit(1)), "total": F.round(F.sum(v), 2), "lo": F.min(v), "hi": F.max(v)}
    d = ts.downsample(t.events, "ts", "6 hours", aggs, "2024-01-03", "2024-01-25", ["event_type"])
    return d.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


@query("series_time_weighted_average", "T7", """
WITH e AS (SELECT event_type, ts, value, floor(epoch_us(ts) / 3600000000.0)::BIGINT * 3600 AS bucket, event_id FROM events),
p AS (SELECT *, lead(value) OVER w AS nv, lead(ts) OVER w AS nt FROM e WINDOW w AS (PARTITION BY event_type, bucket ORDER BY ts, event_id))
SELECT event_type, bucket, round(CASE WHEN sum(epoch_us(nt) - epoch_us(ts)) > 0 THEN sum((value + nv) / 2 * ((epoch_us(nt) - epoch_us(ts)) / 1000000.0)) / sum((epoch_us(nt) - epoch_us(ts)) / 1000000.0) ELSE avg(value) END, 5) AS twa FROM p GROUP BY 1, 2""")
def series_time_weighted_average(t: Tables):
    d = ts.time_weighted_average(t.events.select("event_type", "ts", "event_id", "value"), ["event_type"], "ts", "value", 3600, ORDER)
    return d.withColumn("twa", F.round("twa", 5))


@query("series_last_value", "T8", """
SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE ts > TIMESTAMP '2024-01-20 11:00:00' AND ts <= TIMESTAMP '2024-01-20 23:00:00' GROUP BY 1""")
def series_last_value(t: Tables):
    return ts.last_value(t.events, ["user_id"], "ts", "value", "2024-01-20 23:00:00", 12, "event_id")


@query("series_gap_fill", "T9", """
WITH m AS (SELECT event_type, floor(epoch(ts) / 900)::BIGINT * 900 AS bucket, avg(value) AS mean FROM events GROUP BY 1, 2),
g AS (SELECT event_type, unnest(range(min(bucket), max(bucket) + 1, 900)) AS bucket FROM m GROUP BY 1),
f AS (SELECT g.event_type, g.bucket, mean, CASE WHEN mean IS NOT NULL THEN g.bucket END AS t FROM g LEFT JOIN m USING (event_type, bucket)),
w AS (SELECT *, last_value(mean IGNORE NULLS) OVER a AS pv, last_value(t IGNORE NULLS) OVER a AS pt, first_value(mean IGNORE NULLS) OVER b AS nv, first_value(t IGNORE NULLS) OVER b AS nt FROM f
 WINDOW a AS (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, bucket, round(mean, 7) AS mean, round(pv, 7) AS locf, round(coalesce(mean, pv + (nv - pv) / (nt - pt) * (bucket - pt)), 7) AS linear FROM w""")
def series_gap_fill(t: Tables):
    d = ts.gap_fill(t.events, ["event_type"], "ts", "value", 900)
    return d.select("event_type", "bucket", *[F.round(c, 7).alias(c) for c in ("mean", "locf", "linear")])


@query("series_ssa_forecast", "T10")
def series_ssa_forecast(t: Tables):
    daily = t.events.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.sum("value").alias("v"))
    return ts.ssa_forecast(daily, ["event_type"], ["hour"], "v", horizon=24, window=10)


_P = """(0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"""


def _spike_sql(src: str, value: str, cols: str) -> str:
    return f"""
w AS (SELECT *, avg({value}) OVER h AS m, stddev_samp({value}) OVER h AS s FROM {src} WINDOW h AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN s > 0 THEN ({value} - m) / s ELSE 0 END AS score FROM w),
q AS (SELECT *, abs(score) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * (abs(score) / sqrt(2.0))) AS t FROM z),
f AS (SELECT *, t * {_P.format(t='t')} * exp(-x * x) AS p FROM q)
SELECT {cols} FROM f"""


@query("series_spikes", "T11", "WITH " + _spike_sql("events", "value", "event_id, round(score, 4) AS score, round(p, 5) AS p_value, p < 0.05 AS is_spike").lstrip())
def series_spikes(t: Tables):
    d = ts.spikes(_series(t), ["user_id"], ORDER, "value")
    return d.select("event_id", F.round("score", 4).alias("score"), F.round("p_value", 5).alias("p_value"), "is_spike")


@query("series_change_points", "T12", "WITH " + _spike_sql("events", "value", "*").lstrip().replace("SELECT * FROM f", """
b AS (SELECT *, exp(sum(ln(0.1) - 0.9 * ln(greatest(p, 1e-12))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS mart FROM f)
SELECT event_id, mart > 20 AS is_change FROM b""").replace("FROM q)\n", "FROM q),"))
def series_change_points(t: Tables):
    return ts.change_points(_series(t), ["user_id"], ORDER, "value").select("event_id", "is_change")


@query("series_seasonal_spikes", "T13", f"WITH i AS ({IDX}), r AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id, i % 24) AS residual FROM i)," + _spike_sql("r", "residual", "event_id, round(score, 4) AS score, p < 0.05 AS is_spike"))
def series_seasonal_spikes(t: Tables):
    d = ts.seasonal_spikes(_series(t), ["user_id"], ORDER, "value", 24)
    return d.select("event_id", F.round("score", 4).alias("score"), "is_spike")


@query("capacity_forecast", "T14", """
WITH g AS (SELECT user_id, arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS usage, count(*) AS n FROM events GROUP BY 1),
p AS (SELECT user_id, usage, usage + CASE WHEN n > 1 THEN (usage - f) / n ELSE 0 END * 30 AS forecast FROM g)
SELECT user_id, usage, round(forecast, 6) AS forecast, round(forecast / 100.0 * 100, 6) AS utilization, CASE WHEN forecast > 80 THEN 'Scale up immediately' WHEN forecast > 60 THEN 'Plan to scale up within 30 days'
 WHEN forecast < 20 THEN 'Consider scaling down to save costs' ELSE 'Current capacity is adequate' END AS recommendation FROM p""")
def capacity_forecast(t: Tables):
    d = ts.capacity_forecast(_series(t), ["user_id"], ORDER, "value", 30, capacity=100.0)
    return d.withColumns({"forecast": F.round("forecast", 6), "utilization": F.round("utilization", 6)})


# Coordinates are derived from the keys.
def _point(df, key):
    return df.select(F.col(key), ((F.col(key) * 37 * 83) % 18000 / 100 - 90).alias("lat"), ((F.col(key) * 911 * 7) % 36000 / 100 - 180).alias("lon"))


def _point_sql(table, key):
    return f"(SELECT {key}, ({key} * 37 * 83) % 18000 / 100.0::DOUBLE - 90 AS lat, ({key} * 911 * 7) % 36000 / 100.0::DOUBLE - 180 AS lon FROM {table})"


C, S = _point_sql("customer", "c_custkey"), _point_sql("supplier", "s_suppkey")
_HAV = "6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - ({h})))".format(
    h="power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2)")


def _hav(a, b):
    return _HAV.format(a=a, b=b)


_LON = "6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - ({h})))".format(
    h="power(sin(radians(48.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * power(sin(radians(11.0 - lon) / 2), 2)")


@query("geo_distance", "G1", f"SELECT c_custkey, round({_LON}, 6) AS km, round({_LON} * 0.621371, 6) AS miles, round({_LON} * 1000, 3) AS m FROM {C}")
def geo_distance(t: Tables):
    d = lambda unit: geo.haversine(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0), unit)
    return _point(t.customer, "c_custkey").select("c_custkey", F.round(d("km"), 6).alias("km"), F.round(d("miles"), 6).alias("miles"), F.round(d("m"), 3).alias("m"))


@query("geo_within_radius", "G2 G3", f"SELECT c_custkey FROM {C} WHERE {_LON} <= 1500")
def geo_within_radius(t: Tables):
    return geo.within_radius(_point(t.customer, "c_custkey"), "lat", "lon", (48.0, 11.0), 1500).select("c_custkey")


@query("geo_radius_join", "G3", f"SELECT s_suppkey, c_custkey, round({_hav('s.', 'c.')}, 6) AS distance_km FROM {S} s, {C} c WHERE {_hav('s.', 'c.')} <= 400")
def geo_radius_join(t: Tables):
    d = geo.radius_join(_point(t.supplier, "s_suppkey"), _point(t.customer, "c_custkey"), 400, a_id="s_suppkey", b_id="c_custkey")
    return d.withColumn("distance_km", F.round("distance_km", 6))


@query("geo_bounding_box", "G4", f"SELECT c_nationkey, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM {C} JOIN customer USING (c_custkey) GROUP BY 1")
def geo_bounding_box(t: Tables):
    d = t.customer.select("c_nationkey", "c_custkey")
    return geo.bounding_box(_with_point(d), ["c_nationkey"])


def _with_point(d):
    k = F.col("c_custkey")
    return d.withColumns({"lat": (k * 37 * 83) % 18000 / 100 - 90, "lon": (k * 911 * 7) % 36000 / 100 - 180})


@query("geo_centroid", "G5", f"SELECT c_nationkey, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM {C} JOIN customer USING (c_custkey) GROUP BY 1")
def geo_centroid(t: Tables):
    d = geo.centroid(_with_point(t.customer.select("c_nationkey", "c_custkey")), ["c_nationkey"])
    return d.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


# A concave pentagon around a centre derived from each nation key.
_SHAPE = [(-8.3, -11.7), (9.1, -10.2), (1.4, 0.6), (10.3, 12.9), (-9.7, 11.3)]
_EDGE_SQL = ", ".join(
    f"({i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, (a, b) in enumerate(zip(_SHAPE, _SHAPE[-1:] + _SHAPE[:-1])))


@query("geo_polygon_join", "G6", f"""
WITH n AS (SELECT n_nationkey, (n_nationkey * 13 % 120)::DOUBLE - 60 AS cy, (n_nationkey * 29 % 300)::DOUBLE - 150 AS cx FROM nation),
e AS (SELECT n_nationkey, cy + dy AS ilat, cx + dx AS ilon, cy + py AS jlat, cx + px AS jlon FROM n, (VALUES {_EDGE_SQL}) s(i, dy, dx, py, px))
SELECT c_custkey, n_nationkey FROM {C} c JOIN e ON (ilon > lon) <> (jlon > lon) AND lat < (jlat - ilat) * (lon - ilon) / (jlon - ilon) + ilat GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def geo_polygon_join(t: Tables):
    shape = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for i, (y, x) in enumerate(_SHAPE)])
    k = F.col("n_nationkey")
    v = t.nation.select(k, F.inline(shape)).select(k, "seq", ((k * 13 % 120).cast("double") - 60 + F.col("dy")).alias("lat"), ((k * 29 % 300).cast("double") - 150 + F.col("dx")).alias("lon"))
    return geo.polygon_join(_point(t.customer, "c_custkey"), v, point_id="c_custkey", polygon_id="n_nationkey")
