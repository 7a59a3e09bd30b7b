"""Ordered computations that survive a hot group.

A plain window puts each partition key on one task.  When the largest group is
within ``spark.tidemark.maxGroupRows`` that is the cheapest exact plan and it is
used as is.  Beyond it the rows are range-partitioned on (keys, order), so a
hot group spreads over many tasks, each task computes its local values, and the
carry of earlier chunks is added back.  A chunk boundary cuts at most one key,
so the carry table never has more rows than there are shuffle partitions and
may be broadcast.

``order`` must be a total order within a group and refer to columns by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tidemark.session import (
    MAX_GROUP_ROWS,
    SMALL_INPUT_BYTES,
    conf_int,
    estimated_bytes,
    materialize,
    shuffle_partitions,
)

_CHUNK, _LOCAL, _POS, _BLOCK, _OWN = "_tm_chunk", "_tm_local", "_tm_pos", "_tm_block", "_tm_own"


def group_fits(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when every group of ``keys`` is small enough for one task."""
    spark = df.sparkSession
    if limit is None:
        limit = conf_int(spark, MAX_GROUP_ROWS)
        size = estimated_bytes(df)
        if size is not None and size <= conf_int(spark, SMALL_INPUT_BYTES):
            return True
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) <= limit


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hint: str | None = None
) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the keys come from the left."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    if hint:
        renamed = renamed.hint(hint)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def full_null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer equi-join where null equals null; keys from the side that has them."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, "full").withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys}).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    position: str | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    limit: int | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Add 1-based ``position``, inclusive running ``sums`` and last-non-null ``lasts``.

    ``fits`` passes on the answer of an earlier ``group_fits`` on the same keys.
    """
    sums, lasts = sums or {}, lasts or {}
    frame = (W.unboundedPreceding, W.currentRow)
    if group_fits(df, keys, limit) if fits is None else fits:
        w = W.partitionBy(*keys).orderBy(*order)
        new = {position: F.row_number().over(w).cast("long")} if position else {}
        new |= {o: F.sum(c).over(w.rowsBetween(*frame)) for o, c in sums.items()}
        new |= {o: F.last(c, ignorenulls=True).over(w.rowsBetween(*frame)) for o, c in lasts.items()}
        return df.withColumns(new)

    spark = df.sparkSession
    w = W.partitionBy(*keys, _CHUNK).orderBy(*order)
    local = (
        df.repartitionByRange(shuffle_partitions(spark), *keys, *order)
        .withColumn(_CHUNK, F.spark_partition_id())
        .withColumns(
            {_LOCAL: F.row_number().over(w).cast("long")}
            | {o: F.sum(c).over(w.rowsBetween(*frame)) for o, c in sums.items()}
            | {o: F.last(c, ignorenulls=True).over(w.rowsBetween(*frame)) for o, c in lasts.items()}
        )
    )
    local = materialize(local, "ordered")
    per_chunk = local.groupBy(*keys, _CHUNK).agg(
        F.max(_LOCAL).alias("_c_n"),
        *[F.max_by(o, _LOCAL).alias(f"_c_{o}") for o in [*sums, *lasts]],
    )
    earlier = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys,
        _CHUNK,
        F.sum("_c_n").over(earlier).alias("_p_n"),
        *[F.sum(f"_c_{o}").over(earlier).alias(f"_p_{o}") for o in sums],
        *[F.last(f"_c_{o}", ignorenulls=True).over(earlier).alias(f"_p_{o}") for o in lasts],
    ).where("_p_n is not null")
    out = null_safe_join(local, carry, [*keys, _CHUNK], "left", "broadcast")

    def add(o: str) -> Column:
        both = F.coalesce(F.col(o), F.lit(0)) + F.coalesce(F.col(f"_p_{o}"), F.lit(0))
        return F.when(F.col(o).isNotNull() | F.col(f"_p_{o}").isNotNull(), both)

    cols = [F.col(c) for c in df.columns if c not in (position, *sums, *lasts)]
    if position:
        cols.append((F.col(_LOCAL) + F.coalesce("_p_n", F.lit(0))).alias(position))
    cols += [add(o).alias(o) for o in sums]
    cols += [F.coalesce(F.col(o), F.col(f"_p_{o}")).alias(o) for o in lasts]
    return out.select(*cols)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    before: int = 0,
    after: int = 0,
    limit: int | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Window expressions whose frame reaches at most ``before``/``after`` rows.

    ``build`` receives the window (partitioned and ordered) and returns the new
    columns.  A hot group is cut into blocks of consecutive rows; the rows near
    a block edge are copied to the neighbour so every frame is complete.
    """
    if group_fits(df, keys, limit) if fits is None else fits:
        return df.withColumns(build(W.partitionBy(*keys).orderBy(*order)))
    block_rows = max(limit or conf_int(df.sparkSession, MAX_GROUP_ROWS), before, after, 1)
    numbered = running(df, keys, order, position=_POS, fits=False)
    own = F.floor((F.col(_POS) - 1) / block_rows)
    offset = F.col(_POS) - 1 - F.col(_OWN) * block_rows
    copies = F.array_compact(
        F.array(
            F.col(_OWN),
            F.when(offset >= block_rows - before, F.col(_OWN) + 1),
            F.when((offset < after) & (F.col(_OWN) > 0), F.col(_OWN) - 1),
        )
    )
    w = W.partitionBy(*keys, _BLOCK).orderBy(_POS)
    return (
        numbered.withColumn(_OWN, own)
        .withColumn(_BLOCK, F.explode(copies))
        .withColumns(build(w))
        .where(F.col(_BLOCK) == F.col(_OWN))
        .drop(_POS, _OWN, _BLOCK)
    )


def range_framed(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    fits: bool | None = None,
) -> DataFrame:
    """Window expressions over rows whose integer ``value`` lies within ``reach``
    below the current one.  A hot group is cut into blocks of width ``reach``;
    a row is copied to the block after its own, which completes every frame."""
    if group_fits(df, keys) if fits is None else fits:
        return df.withColumns(build(W.partitionBy(*keys).orderBy(value).rangeBetween(-reach, 0)))
    own = F.floor(F.col(value) / reach)
    w = W.partitionBy(*keys, _BLOCK).orderBy(value).rangeBetween(-reach, 0)
    return (
        df.withColumn(_OWN, own)
        .withColumn(_BLOCK, F.explode(F.array(F.col(_OWN), F.col(_OWN) + 1)))
        .withColumns(build(w))
        .where(F.col(_BLOCK) == F.col(_OWN))
        .drop(_OWN, _BLOCK)
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows per group.  Spark trims each map task to k rows per key
    (WindowGroupLimit) before the shuffle, so a hot key ships k rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_POS, F.row_number().over(w)).where(F.col(_POS) <= k).drop(_POS)
