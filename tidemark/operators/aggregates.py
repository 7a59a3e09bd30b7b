"""Group and global aggregates by specification, exact at any group size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import stats
from tidemark.operators.ordered import null_safe_join
from tidemark.operators.selection import Selection, interpolated, nearest
from tidemark.session import MAX_GROUP_ROWS, conf_int, materialize, spread

_SIMPLE = {
    "count": lambda x, p: stats.non_null_count(x),
    "sum": lambda x, p: F.sum(x),
    "average": lambda x, p: F.avg(x),
    "min": lambda x, p: F.min(x),
    "max": lambda x, p: F.max(x),
    "variance": lambda x, p: F.var_pop(x),
    "stddev": lambda x, p: F.stddev_pop(x),
    "range": lambda x, p: F.max(x) - F.min(x),
    "skewness": lambda x, p: stats.sample_skewness(x),
    "kurtosis": lambda x, p: stats.sample_kurtosis(x),
    "geometric_mean": lambda x, p: stats.geometric_mean(x),
    "harmonic_mean": lambda x, p: stats.harmonic_mean(x),
    "rms": lambda x, p: stats.root_mean_square(x),
    "cv": lambda x, p: stats.coefficient_of_variation(x),
    "z_score": lambda x, p: stats.z_score(x, p),
    "percentile_rank": lambda x, p: stats.percentile_rank(x, p),
    "distinct_count": lambda x, p: F.count_distinct(x),
    "approx_distinct_count": lambda x, p: F.approx_count_distinct(x),
}


def _quartile(p) -> list[float]:
    if p not in (1, 2, 3):
        raise ValueError("quartile must be 1, 2 or 3")
    return [p * 0.25]


_QUANTILE = {
    "median": lambda p: [0.5],
    "percentile": lambda p: [(50 if p is None else p) / 100],
    "quartile": _quartile,
    "iqr": lambda p: [0.25, 0.75],
}
_NEAREST = {"nearest_rank": lambda p: p, "upper_median": lambda p: 0.5}


@dataclass(frozen=True)
class Agg:
    """One aggregate: ``function`` over ``column``, optional parameter and name."""

    column: str
    function: str
    name: str | None = None
    param: float | None = None

    @property
    def out(self) -> str:
        return self.name or f"{self.function}_{self.column}"


def as_number(df: DataFrame, column: str, coerce_zero: bool = False) -> Column:
    """Numeric view of a column; text that does not parse is null, or 0 on request."""
    x = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        x = x.try_cast("double")
        return F.when(F.col(column).isNotNull(), F.coalesce(x, F.lit(0.0))) if coerce_zero else x
    return x.cast("double")


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows per (keys, value): combined map-side, so a hot key or value stays small."""
    return df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))


def quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles as columns ``q0..``, by selection."""
    parts = [interpolated(f"_q{i}", p) for i, p in enumerate(probs)]
    found = Selection(df, keys, column).at({n: r for ranks, _ in parts for n, r in ranks.items()})
    out = found.select(*keys, *[v.alias(f"q{i}") for i, (_, v) in enumerate(parts)])
    return out if keys else _one_row(out)


def nearest_ranks(df: DataFrame, keys: Sequence[str], column: str, probs: dict[str, float]) -> DataFrame:
    """Element at index min(floor(p*n), n-1) of each sorted group."""
    out = Selection(df, keys, column).at({n: nearest(p) for n, p in probs.items()}).drop("_total")
    return out if keys else _one_row(out)


def _one_row(df: DataFrame) -> DataFrame:
    """A global result has a row, of nulls, also where there is no value."""
    return df.agg(*[F.first(c, ignorenulls=True).alias(c) for c in df.columns])


def modes(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Most frequent value, lowest on ties; counts are combined before the argmax."""
    counts = value_counts(df, keys, column)
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(out))


def median_absolute_deviation(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Median of |x - median|, both by selection from one set of bucket counts."""
    chosen = Selection(df, keys, column)
    ranks, value = interpolated("_m", 0.5)
    return chosen.deviation(materialize(chosen.at(ranks).select(*keys, value.alias("_med")), "medians"), out)


#: groups up to this size keep their values in one task's memory; there are at most ``_HOT`` larger ones
_SMALL_GROUP, _HOT = 500_000, 100_000


def _large_groups(df: DataFrame, keys: Sequence[str], limit: int | None) -> tuple[DataFrame | None, bool]:
    """(keys of the groups too large to gather, at most ``_HOT`` of them; are these all groups)."""
    small = min(_SMALL_GROUP, conf_int(df.sparkSession, MAX_GROUP_ROWS)) if limit is None else limit
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    groups, total, most = counts.agg(F.count(F.lit(1)), F.sum("_n"), F.max("_n")).first()
    cut = max(small, (total or 0) // _HOT)
    if (most or 0) <= cut:
        return None, False
    if not keys:
        return df.sparkSession.range(1).select(), True
    large = materialize(counts.where(F.col("_n") > cut).select(*keys), "large-groups")
    return large, large.count() == groups


def group_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[Agg],
    *,
    coerce_zero: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Keys followed by the requested aggregates.

    Mergeable statistics share one hash aggregate.  Order statistics of groups that
    a task can hold join it; those of larger groups are selected from bucket counts.
    """
    ks = list(keys)
    wanted = {a.column for a in specs if a.function != "distinct_count"}
    base = df.select(
        *keys,
        *[as_number(df, c, coerce_zero).alias(f"_v_{c}") for c in sorted(wanted)],
        *[F.col(c).alias(f"_d_{c}") for c in sorted({a.column for a in specs if a.function == "distinct_count"})],
    )
    simple: list[Column] = []
    final: dict[str, Column] = {}
    probs: dict[str, list[float]] = {}  # all order statistics of a column share its scans
    near: dict[str, dict[str, float]] = {}
    mode_of: dict[str, str] = {}
    mad_of: dict[str, str] = {}

    def q(column: str, p: float) -> Column:
        ps = probs.setdefault(column, [])
        if p not in ps:
            ps.append(p)
        return F.col(f"_q_{column}")[ps.index(p)]

    for a in specs:
        name = f"_v_{a.column}"
        final[a.out] = F.col(a.out)
        if a.function == "distinct_count":
            simple.append(F.count_distinct(f"_d_{a.column}").alias(a.out))
        elif a.function in _SIMPLE:
            simple.append(_SIMPLE[a.function](F.col(name), a.param).alias(a.out))
        elif a.function in _QUANTILE:
            qs = [q(name, p) for p in _QUANTILE[a.function](a.param)]
            final[a.out] = qs[1] - qs[0] if len(qs) == 2 else qs[0]
        elif a.function == "mode":
            mode_of[a.out] = name
        elif a.function == "mad":
            mad_of[a.out] = name
        elif a.function in _NEAREST:
            near.setdefault(name, {})[a.out] = _NEAREST[a.function](a.param)
        else:
            raise ValueError(f"unknown aggregate {a.function}")
    ordered = bool(probs or near or mode_of or mad_of)
    large, only = _large_groups(base, ks, limit) if ordered else (None, False)
    if large is None:
        base = spread(base) if ordered else base  # sorting is CPU-bound, scanning is not
        return _gathered(base, ks, simple, probs, near, mode_of, mad_of).select(*keys, *[c.alias(n) for n, c in final.items()])
    wider = spread(base)
    if wider is not base:  # fewer splits than cores: dealt out once for all scans
        base = materialize(wider, "dealt")
    head = base.groupBy(*ks).agg(*(simple or [F.lit(1).alias("_one")]))
    frames = _selected(base if only else null_safe_join(base, large, ks, "left_semi", "broadcast"), ks, probs, near, mode_of, mad_of)
    if not ks:  # one row each: stack them and keep what is set
        return _one_row(reduce(lambda l, r: l.unionByName(r, allowMissingColumns=True), frames, head)).select(*[c.alias(n) for n, c in final.items()])
    found = reduce(lambda l, r: null_safe_join(l, r, ks, "left"), frames)
    if not only:
        rest = null_safe_join(base, large, ks, "left_anti", "broadcast")
        found = found.unionByName(_gathered(rest, ks, [], probs, near, mode_of, mad_of))
    return null_safe_join(head, found, ks, "left").select(*keys, *[c.alias(n) for n, c in final.items()])


def _gathered(df: DataFrame, ks: list[str], simple: list[Column], probs: dict, near: dict, mode_of: dict, mad_of: dict) -> DataFrame:
    """All statistics of groups that fit a task: one hash aggregate, one sorted array per group and column."""
    columns = sorted({*probs, *near, *mad_of.values()})
    aggs = [*simple, *[F.mode(F.col(c) + F.lit(0.0), True).alias(out) for out, c in mode_of.items()], *[F.collect_list(c).alias(f"_l_{c}") for c in columns]]
    out = df.groupBy(*ks).agg(*(aggs or [F.lit(1).alias("_one")]))
    out = out.withColumns({f"_l_{c}": F.sort_array(f"_l_{c}") for c in columns})
    for c, ps in probs.items():
        out = out.withColumn(f"_q_{c}", F.array(*[_between(f"_l_{c}", p) for p in ps]))
    for c, ranks in near.items():
        out = out.withColumns({n: F.get(f"_l_{c}", nearest(p)(F.size(f"_l_{c}")).cast("int")) for n, p in ranks.items()})
    for n, c in mad_of.items():
        far = F.sort_array(_distances(f"_l_{c}", F.col("_middle")))
        out = out.withColumn("_middle", _between(f"_l_{c}", 0.5)).withColumn("_far", far).withColumn(n, _between("_far", 0.5)).drop("_middle", "_far")
    return out.drop(*[f"_l_{c}" for c in columns])


def _between(values: str, p: float) -> Column:
    """Interpolated quantile of a sorted array; null if it is empty."""
    at = (F.size(values) - 1) * F.lit(float(p))
    lo, hi = (F.get(values, f(at).cast("int")) for f in (F.floor, F.ceil))
    return lo + F.when(hi == lo, 0.0).otherwise((hi - lo) * (at - F.floor(at)))


def _distances(values: str, middle: Column) -> Column:
    # never null where there is a value: arrays without nulls sort as primitives
    return F.transform(values, lambda x: F.coalesce(F.abs(x - middle), F.lit(0.0)))


def _selected(df: DataFrame, ks: list[str], probs: dict, near: dict, mode_of: dict, mad_of: dict) -> list[DataFrame]:
    """Order statistics of large groups, one frame per column and one per mode."""
    frames = []
    for c in sorted({*probs, *near, *mad_of.values()}):
        chosen = Selection(df, ks, c)
        parts = [interpolated(f"_q{i}", p) for i, p in enumerate(probs.get(c, []))]
        middle, median = interpolated("_mid", 0.5)
        mads = [n for n, x in mad_of.items() if x == c]
        ranks = {n: r for own, _ in parts for n, r in own.items()} | {n: nearest(p) for n, p in near.get(c, {}).items()} | (middle if mads else {})
        found = chosen.at(ranks)
        outs = [F.array(*[v for _, v in parts]).alias(f"_q_{c}")] if parts else []
        if mads:
            found = materialize(found.withColumn("_med", median), "selected")
            deviation = chosen.deviation(found.select(*ks, "_med"), "_mad")
            frames.append(deviation.select(*ks, *[F.col("_mad").alias(n) for n in mads]))
        if outs or near.get(c):
            frames.append(found.select(*ks, *outs, *near.get(c, {})))
    return frames + [modes(df, ks, c, out) for out, c in mode_of.items()]


def aggregate(df: DataFrame, specs: Sequence[Agg], **kw) -> DataFrame:
    """Global aggregate: one row."""
    return group_aggregate(df, [], specs, **kw)


def aggregate_with_totals(df: DataFrame, keys: Sequence[str], exprs: dict[str, Column]) -> DataFrame:
    """Totals row and group rows from one pass; ``is_total`` tells them apart."""
    named = [e.alias(n) for n, e in exprs.items()]
    sets = df.groupingSets([[], [F.col(k) for k in keys]], *[F.col(k) for k in keys])
    marker = (F.grouping_id() > 0).alias("is_total")
    return sets.agg(marker, *named)


def bucket_counts(df: DataFrame, column: str, boundaries: Sequence[float], out: str = "bucket") -> DataFrame:
    """Rows per half-open bucket, labelled by its lower bound; null outside all buckets."""
    x, label = F.col(column), F.lit(None).cast("double")
    for lo, hi in zip(boundaries, boundaries[1:]):
        label = F.when((x >= lo) & (x < hi), F.lit(float(lo))).otherwise(label)
    return df.groupBy(label.alias(out)).agg(F.count(F.lit(1)).alias("n"))


_ACCUMULATORS = {
    "$sum": F.sum,
    "$avg": F.avg,
    "$min": F.min,
    "$max": F.max,
    "$count": lambda c: F.count(F.lit(1)),
}


def document_group(df: DataFrame, by: str, accumulators: dict[str, tuple[str, str]]) -> DataFrame:
    """Group stage: ``_id`` plus ``{out: (accumulator, field)}``."""
    aggs = [_ACCUMULATORS[f](c).alias(out) for out, (f, c) in accumulators.items()]
    return df.groupBy(F.col(by).alias("_id")).agg(*aggs)


def collection_stats(df: DataFrame) -> DataFrame:
    size = F.octet_length(F.to_json(F.struct("*")))
    return df.agg(F.count(F.lit(1)).alias("documents"), F.avg(size).alias("avg_size"))


def facets(branches: dict[str, DataFrame]) -> DataFrame:
    """Several results over one input as a single frame tagged by ``facet``."""
    tagged = [d.select(F.lit(n).alias("facet"), *d.columns) for n, d in branches.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def metric_histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts with sum and count, one row per bound (null = +Inf)."""
    x = F.col(value)
    wide = df.groupBy(*keys).agg(
        *[F.count_if(x <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(x).alias("observations"),
        F.sum(x).alias("total"),
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("observations").alias("n")))
    return wide.select(*keys, "observations", "total", F.inline(F.array(*rows)))
