"""Window functions by name with an explicit value column.

``order_by`` entries are column names, ``-name`` for descending.  The first one
decides ties of the ranking functions; the full list must be a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordered import framed, group_fits, null_safe_join, running


def order_columns(names: Sequence[str]) -> list[Column]:
    """``-name`` sorts descending; nulls come first ascending and last descending."""
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in names]


def with_group_size(df: DataFrame, keys: Sequence[str], out: str, fits: bool) -> DataFrame:
    if fits:
        return df.withColumn(out, F.count(F.lit(1)).over(W.partitionBy(*keys)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return null_safe_join(df, sizes, keys)


def _tie_ranks(df: DataFrame, keys: Sequence[str], first: str, limit: int | None) -> DataFrame:
    """Rank, dense rank, rows up to and including a tie, and group size per row.

    Ties collapse to one row per (keys, value) before anything is ordered."""
    name = first.lstrip("-")
    counts = df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_tie"))
    cum = running(counts, keys, order_columns([first]), position="_dense", sums={"_upto": F.col("_tie")}, limit=limit)
    per_value = cum.select(*keys, name, "_dense", "_upto", (F.col("_upto") - F.col("_tie") + 1).alias("_rank"))
    return null_safe_join(df, per_value, [*keys, name])


def window_fn(
    df: DataFrame,
    fn: str,
    out: str,
    *,
    value: str | None = None,
    partition_by: Sequence[str] = (),
    order_by: Sequence[str],
    offset: int = 1,
    buckets: int = 4,
    frame: int = 3,
    sql_ties: bool = False,
    limit: int | None = None,
) -> DataFrame:
    keys, order = list(partition_by), order_columns(order_by)
    x = F.col(value) if value else None
    if fn in ("lag", "lead"):
        shift = (lambda w: F.lag(x, offset).over(w)) if fn == "lag" else (lambda w: F.lead(x, offset).over(w))
        reach = {"before": offset} if fn == "lag" else {"after": offset}
        return framed(df, keys, order, lambda w: {out: shift(w)}, limit=limit, **reach)
    if fn == "moving_avg":
        avg = F.avg(F.coalesce(x, F.lit(0)))
        return framed(df, keys, order, lambda w: {out: avg.over(w.rowsBetween(1 - frame, 0))}, before=frame - 1, limit=limit)
    if fn == "row_number":
        return running(df, keys, order, position=out, limit=limit)
    if fn == "cumulative_sum":
        return running(df, keys, order, sums={out: F.coalesce(x, F.lit(0))}, limit=limit)
    if fn == "running_avg":
        d = running(df, keys, order, position="_pos", sums={out: F.coalesce(x, F.lit(0))}, limit=limit)
        return d.withColumn(out, F.col(out) / F.col("_pos")).drop("_pos")

    fits = group_fits(df, keys, limit)
    ties = W.partitionBy(*keys).orderBy(*order_columns(order_by[:1]))
    if fn in ("rank", "dense_rank"):
        if fits:
            ranked = F.rank() if fn == "rank" else F.dense_rank()
            return df.withColumn(out, ranked.over(ties).cast("long"))
        d = _tie_ranks(df, keys, order_by[0], limit)
        return d.withColumn(out, F.col("_rank" if fn == "rank" else "_dense")).drop("_rank", "_dense", "_upto")
    if fn in ("first_value", "last_value"):
        if fits:
            w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            return df.withColumn(out, (F.first(x) if fn == "first_value" else F.last(x)).over(w))
        pos = running(df, keys, order, position="_pos", fits=False)
        pick = F.min_by if fn == "first_value" else F.max_by
        return null_safe_join(df, pos.groupBy(*keys).agg(pick(value, "_pos").alias(out)), keys)

    if fn in ("percent_rank", "cume_dist") and sql_ties:
        if fits:
            return df.withColumn(out, (F.percent_rank() if fn == "percent_rank" else F.cume_dist()).over(ties))
        d = with_group_size(_tie_ranks(df, keys, order_by[0], limit), keys, "_n", False)
        top, bottom = (F.col("_rank") - 1, F.col("_n") - 1) if fn == "percent_rank" else (F.col("_upto"), F.col("_n"))
        return d.withColumn(out, F.when(bottom > 0, top / bottom).otherwise(0.0)).drop("_rank", "_dense", "_upto", "_n")
    d = with_group_size(running(df, keys, order, position="_pos", fits=fits), keys, "_n", fits)
    pos, n = F.col("_pos"), F.col("_n")
    if fn == "percent_rank":
        expr = F.when(n > 1, (pos - 1) / (n - 1)).otherwise(0.0)
    elif fn == "cume_dist":
        expr = pos / n
    elif fn == "ntile" and sql_ties:  # SQL ntile: the first n % buckets buckets get one row more
        small, extra = F.floor(n / buckets), n % buckets
        wide = extra * (small + 1)
        expr = F.when(pos <= wide, F.floor((pos - 1) / (small + 1)) + 1).otherwise(
            extra + F.floor((pos - 1 - wide) / F.greatest(small, F.lit(1))) + 1
        )
    elif fn == "ntile":
        expr = F.least(F.floor((pos - 1) / F.ceil(n / buckets)) + 1, F.lit(buckets))
    else:
        raise ValueError(f"unknown window function {fn}")
    return d.withColumn(out, expr).drop("_pos", "_n")
