"""Time-series operators on (series, ts, value) tables.

Everything that looks at neighbouring rows goes through ``running`` or
``framed``, so one dominating series is still split over many tasks.
``order`` is a total order within a series, usually [ts, id].
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import framed, null_safe_join, running, top_per_group


def trend(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Least squares of the value on the row index 0..n-1."""
    x = (F.col("_pos") - 1).cast("double")
    fit = running(df, series, order, position="_pos").groupBy(*series).agg(
        F.regr_slope(F.col(value), x).alias("slope"), F.regr_intercept(F.col(value), x).alias("intercept"))
    way = F.when(F.col("slope") > 0, "Increasing").when(F.col("slope") < 0, "Decreasing").otherwise("Stable")
    return fit.withColumn("direction", way)


def autocorrelation(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, lag: int) -> DataFrame:
    """sum (x_i - m)(x_{i+k} - m) / sum (x_i - m)^2 with the mean of the whole series.

    One pass: the pair sum is the pairs' covariance plus the shift of their means."""
    x, y = F.col(value), F.when(F.col("_later").isNotNull(), F.col("_later"))
    paired = F.when(F.col("_later").isNotNull(), x)
    d = framed(df, series, order, lambda w: {"_later": F.lead(value, lag).over(w)}, after=lag)
    g = d.groupBy(*series).agg(
        F.count(x).alias("n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"), F.count(y).alias("_k"),
        F.covar_pop(paired, y).alias("_c"), F.avg(paired).alias("_mx"), F.avg(y).alias("_my"))
    num = F.col("_k") * (F.col("_c") + (F.col("_mx") - F.col("_m")) * (F.col("_my") - F.col("_m")))
    r = F.when(F.col("_v") > 0, num / (F.col("_v") * F.col("n"))).otherwise(0.0)
    return g.select(*series, "n", F.when(F.col("_k") > 0, r).otherwise(0.0).alias("r"))


def seasonality(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, period: int = 7) -> DataFrame:
    """Seasonal when n >= 2 * period and |r(period)| > 0.5; strength = |r|."""
    a = autocorrelation(df, series, order, value, period)
    enough = F.col("n") >= 2 * period
    strength = F.when(enough, F.abs("r")).otherwise(0.0)
    return a.select(*series, (strength > 0.5).alias("seasonal"), F.lit(period).alias("period"), strength.alias("strength"))


def naive_forecast(df: DataFrame, series: Sequence[str], ts: str, value: str, horizon: int = 30) -> DataFrame:
    """Last value repeated at the last interval (a day when there is one point)."""
    two = top_per_group(df.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp"))), series, [F.desc(ts)], 2)
    g = two.groupBy(*series).agg(F.max("_s").alias("_hi"), F.min("_s").alias("_lo"), F.count(F.lit(1)).alias("_n"), F.max_by(value, "_s").alias("forecast"))
    step = F.when(F.col("_n") == 1, F.lit(86_400_000_000)).otherwise(F.col("_hi") - F.col("_lo"))
    out = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return out.select(*series, "step", F.timestamp_micros(F.col("_hi") + step * F.col("step")).cast("timestamp_ntz").alias("ts"), "forecast")


def series_statistics(df: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*series).agg(F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def downsample(df: DataFrame, ts: str, every: str, aggs: Mapping[str, Column], start=None, stop=None, keys: Sequence[str] = ()) -> DataFrame:
    """Fixed buckets over an inclusive time range."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        df = df.where(F.col(ts) <= F.lit(stop).cast("timestamp_ntz"))
    g = df.groupBy(*keys, F.window(ts, every).alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(*keys, F.col("_w.start").alias("bucket"), *aggs)


def time_weighted_average(df: DataFrame, keys: Sequence[str], ts: str, value: str, every_seconds: int, order: Sequence[str]) -> DataFrame:
    """Linear time-weighted mean inside each bucket; a single point is its own mean."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    d = df.withColumn("_us", micros).withColumn("bucket", F.floor(F.col("_us") / (every_seconds * 1_000_000)) * every_seconds)
    d = framed(d, [*keys, "bucket"], order, lambda w: {"_nv": F.lead(value).over(w), "_nt": F.lead("_us").over(w)}, after=1)
    span = (F.col("_nt") - F.col("_us")) / 1e6
    g = d.groupBy(*keys, "bucket").agg(F.sum((F.col(value) + F.col("_nv")) / 2 * span).alias("_a"), F.sum(span).alias("_t"), F.avg(value).alias("_m"))
    return g.select(*keys, "bucket", F.when(F.col("_t") > 0, F.col("_a") / F.col("_t")).otherwise(F.col("_m")).alias("twa"))


def last_value(df: DataFrame, series: Sequence[str], ts: str, value: str, now, hours: float, tie: str) -> DataFrame:
    """Latest value per series within the trailing window that ends at ``now``."""
    upper = F.lit(now).cast("timestamp_ntz")
    recent = df.where((F.col(ts) > upper - F.make_dt_interval(hours=F.lit(int(hours)))) & (F.col(ts) <= upper))
    return recent.groupBy(*series).agg(F.max_by(value, F.struct(ts, tie)).alias("last_value"))


def gap_fill(df: DataFrame, series: Sequence[str], ts: str, value: str, every_seconds: int) -> DataFrame:
    """Regular grid from first to last bucket per series: bucket mean, carried value
    (``locf``) and linear interpolation between filled buckets.  Each filled bucket
    makes the buckets up to the next filled one."""
    b = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / every_seconds) * every_seconds
    means = df.groupBy(*series, b.alias("bucket")).agg(F.avg(value).alias("mean"))
    filled = means.where("mean is not null")
    ends = means.groupBy(*series).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    known = framed(filled, series, ["bucket"], lambda w: {"_next": F.lead(F.struct("bucket", "mean")).over(w), "_prev": F.lag("bucket").over(w)}, before=1, after=1)
    known = null_safe_join(known, ends, series, "left")
    step = F.lit(every_seconds).cast("long")
    # the first filled bucket also makes the empty ones before it, the last one those behind
    start = F.when(F.col("_prev").isNull(), F.col("_a")).otherwise(F.col("bucket"))
    stop = F.coalesce(F.col("_next.bucket") - step, "_b")
    grid = known.withColumn("_t", F.explode(F.sequence(start, stop, step)))
    slope = (F.col("_next.mean") - F.col("mean")) / (F.col("_next.bucket") - F.col("bucket"))
    ahead = F.col("_t") - F.col("bucket")
    out = grid.select(
        *series, F.col("_t").alias("bucket"), F.when(ahead == 0, F.col("mean")).alias("mean"), F.when(ahead >= 0, F.col("mean")).alias("locf"),
        F.when(ahead == 0, F.col("mean")).when(ahead > 0, F.col("mean") + slope * ahead).alias("linear"))
    empty = null_safe_join(ends, filled.select(*series).distinct(), series, "left_anti")
    bare = empty.select(*series, F.explode(F.sequence("_a", "_b", step)).alias("bucket"), *[F.lit(None).cast("double").alias(c) for c in ("mean", "locf", "linear")])
    return out.unionByName(bare)


def two_sided_p(z: Column) -> Column:
    """Normal two-sided p-value by the rational erfc approximation (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def spikes(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, confidence: float = 95, history: int = 50) -> DataFrame:
    """Deviation from the previous ``history`` rows: score z, p-value and alert flag."""
    v = F.col(value)

    def past(w):
        frame = w.rowsBetween(-history, -1)
        return {"_m": F.avg(v).over(frame), "_s": F.stddev_samp(v).over(frame)}

    d = framed(df, series, order, past, before=history)
    score = F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s")).otherwise(0.0)
    d = d.withColumn("score", score).withColumn("p_value", two_sided_p(F.col("score")))
    return d.withColumn("is_spike", F.col("p_value") < 1 - confidence / 100).drop("_m", "_s")


def change_points(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, history: int = 50, epsilon: float = 0.1, threshold: float = 20.0) -> DataFrame:
    """Power martingale over the last ``history`` p-values: product of e * p^(e-1);
    a change is flagged where it exceeds ``threshold``."""
    d = spikes(df, series, order, value, history=history)
    bet = F.log(F.lit(epsilon)) + (epsilon - 1) * F.log(F.greatest("p_value", F.lit(1e-12)))
    d = d.withColumn("_bet", bet)
    d = framed(d, series, order, lambda w: {"martingale": F.exp(F.sum("_bet").over(w.rowsBetween(1 - history, 0)))}, before=history)
    return d.withColumn("is_change", F.col("martingale") > threshold).drop("_bet", "is_spike")


def seasonal_spikes(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, season: int = 24, **kw) -> DataFrame:
    """Spikes of what is left after the mean of each phase (row index mod season)."""
    d = running(df, series, order, position="_pos").withColumn("_phase", (F.col("_pos") - 1) % season)
    phase = d.groupBy(*series, "_phase").agg(F.avg(value).alias("_pm"))
    d = null_safe_join(d, phase, [*series, "_phase"]).withColumn("residual", F.col(value) - F.col("_pm"))
    return spikes(d.drop("_pos", "_phase", "_pm"), series, order, "residual", **kw)


def capacity_forecast(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, days: int = 30, capacity: float = 1000.0) -> DataFrame:
    """usage + (last - first) / n * days, with advice by utilisation."""
    at = F.struct(*order)
    g = df.groupBy(*keys).agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("usage"), F.count(F.lit(1)).alias("_n"))
    growth = F.when(F.col("_n") > 1, (F.col("usage") - F.col("_first")) / F.col("_n")).otherwise(0.0)
    d = g.select(*keys, "usage", (F.col("usage") + growth * days).alias("forecast"))
    pct = F.col("forecast") / capacity * 100
    # fixed values: thresholds and wording of the advice
    advice = (F.when(pct > 80, "Scale up immediately").when(pct > 60, "Plan to scale up within 30 days")
              .when(pct < 20, "Consider scaling down to save costs").otherwise("Current capacity is adequate"))
    return d.select("*", pct.alias("utilization"), advice.alias("recommendation"))


def ssa_forecast(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, horizon: int, window: int = 10, variance: float = 0.95) -> DataFrame:
    """Singular spectrum forecast with 95 % bounds, many series in parallel.

    The window x window lag-covariance is a Spark aggregate over the whole series;
    Python only sees that matrix and the last 2 * window - 1 points per series.
    """
    lags = {f"_x{i}": i for i in range(window)}
    emb = framed(df.select(*series, *order, F.col(value).cast("double").alias("_v")), series, order,
                 lambda w: {n: F.lag("_v", window - 1 - i).over(w) for n, i in lags.items()}, before=window)
    emb = emb.where("_x0 is not null")
    pairs = [(i, j) for i in range(window) for j in range(i, window)]
    cov = emb.groupBy(*series).agg(F.count(F.lit(1)).alias("_k"), F.array(*[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs]).alias("_c"))
    tail = running(top_per_group(df, series, [F.col(o).desc() for o in order], 2 * window - 1), series, order, position="_p", fits=True)
    tail = tail.groupBy(*series).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(value).cast("double").alias("v")))), lambda s: s.v).alias("_t"))
    state = null_safe_join(cov, tail, series)

    def forecast(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                fc, sd = _ssa(np.asarray(rec["_c"]), np.asarray(rec["_t"]), rec["_k"], window, horizon, variance)
                rows += [(*[rec[s] for s in series], h + 1, f, f - 1.96 * sd, f + 1.96 * sd) for h, f in enumerate(fc)]
            yield pd.DataFrame(rows, columns=[*series, "step", "forecast", "lower", "upper"])

    schema = ", ".join(f"`{s}` {df.schema[s].dataType.simpleString()}" for s in series) + ", step int, forecast double, lower double, upper double"
    return state.mapInPandas(forecast, schema)


def _ssa(c: np.ndarray, tail: np.ndarray, k: int, window: int, horizon: int, variance: float) -> tuple[list[float], float]:
    m = np.zeros((window, window))
    m[np.triu_indices(window)] = c
    m = m + np.triu(m, 1).T
    w, v = np.linalg.eigh(m)
    w, v = np.clip(w[::-1], 0, None), v[:, ::-1]
    total = w.sum()
    if total == 0:
        return [0.0] * horizon, 0.0
    rank = min(int(np.searchsorted(np.cumsum(w) / total, variance)) + 1, window - 1)
    p = v[:, :rank]
    nu = min(float((p[-1] ** 2).sum()), 1 - 1e-9)
    recurrence = p[:-1] @ p[-1] / (1 - nu)
    # reconstruct the tail: project its windows and average the anti-diagonals
    hankel = np.lib.stride_tricks.sliding_window_view(tail, window) @ p @ p.T
    sums, counts = np.zeros(len(tail)), np.zeros(len(tail))
    for i, row in enumerate(hankel):
        sums[i:i + window] += row
        counts[i:i + window] += 1
    past = list((sums / counts)[-(window - 1):])
    out = []
    for _ in range(horizon):
        nxt = float(np.dot(recurrence, past))
        out.append(nxt)
        past = past[1:] + [nxt]
    return out, float(np.sqrt(max(total - w[:rank].sum(), 0) / (k * window)))
