"""Reproducible table sampling.

Random order is the md5 of seed and key, so the same rows come back on any
cluster.  Selection first counts rows per 16-bit hash prefix (at most 65,536
groups), finds the prefix that completes the sample, and only then sorts the
rows at or below it, so the sort never sees much more than the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import null_safe_join, top_per_group
from tidemark.operators.windows import order_columns
from tidemark.session import materialize

STRATA_TO_BROADCAST = 100_000

_HASH, _PREFIX = "_tm_hash", "_tm_prefix"


def _hash(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def _hashed(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    return df.withColumn(_HASH, _hash(key, seed)).withColumn(
        _PREFIX, F.conv(F.substring(_HASH, 1, 4), 16, 10).cast("int")
    )


def random_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows with the smallest hashes."""
    hashed = _hashed(df, key, seed)
    counts = hashed.groupBy(_PREFIX).agg(F.count(F.lit(1)).alias("c"))  # <= 65,536 rows
    upto = counts.withColumn("upto", F.sum("c").over(W.orderBy(_PREFIX)))
    edge = upto.where(F.col("upto") >= n).agg(F.min(_PREFIX)).first()[0]
    if edge is None:
        return hashed.drop(_HASH, _PREFIX)
    # everything below the edge, and of the edge, about a 65,536th of the rows, the rest
    below = upto.where(F.col(_PREFIX) < edge).agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    rest = hashed.where(F.col(_PREFIX) == edge).orderBy(_HASH, *key).limit(n - below)
    return hashed.where(F.col(_PREFIX) < edge).unionByName(rest).drop(_HASH, _PREFIX)


def stratified_rows(df: DataFrame, n: int, stratum: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Per stratum the ``ceil(n * rows_in_stratum / rows)`` smallest hashes."""
    hashed = _hashed(df, key, seed)
    counts = hashed.groupBy(stratum, _PREFIX).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy(stratum).agg(F.sum("c").alias("size"))
    total = df.count()
    quota = sizes.select(stratum, F.ceil(F.lit(float(n)) * F.col("size") / F.lit(max(total, 1))).alias("_quota"))
    upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy(stratum).orderBy(_PREFIX)))
    edges = (
        null_safe_join(upto, quota, [stratum])
        .where(F.col("upto") >= F.col("_quota"))
        .groupBy(stratum)
        .agg(F.min(_PREFIX).alias("_edge"), (F.first("_quota") - F.min_by(F.col("upto") - F.col("c"), _PREFIX)).alias("_rest"))
    )
    edges = materialize(edges, "edges")
    # few strata go to every task, so the table is not shuffled by stratum
    near = null_safe_join(hashed, edges, [stratum], hint="broadcast" if edges.count() <= STRATA_TO_BROADCAST else None)
    ranked = near.where(F.col(_PREFIX) == F.col("_edge")).withColumn("_rn", F.row_number().over(W.partitionBy(stratum).orderBy(_HASH, *key)))
    taken = ranked.where(F.col("_rn") <= F.col("_rest")).select(*df.columns)
    return near.where(F.col(_PREFIX) < F.col("_edge")).select(*df.columns).unionByName(taken)


def detect_date_column(df: DataFrame) -> str | None:
    """The date or timestamp column with the most distinct values."""
    found = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    if len(found) < 2:
        return found[0] if found else None
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in found]).first()
    return max(found, key=lambda c: (row[c], c))


def sample(
    df: DataFrame,
    strategy: str,
    n: int = 10_000,
    *,
    key: Sequence[str],
    date_col: str | None = None,
    stratify_col: str | None = None,
    where: str | Column | None = None,
    seed: int = 42,
    max_full_rows: int = 50_000,
) -> DataFrame:
    """random, recent, head, tail, stratified, query or full.

    A table of at most ``max_full_rows`` rows comes back whole; a query keeps
    its predicate.
    """
    if strategy == "query":
        return df.where(where).orderBy(*key).limit(n)
    if strategy == "full" or (max_full_rows > 0 and df.limit(max_full_rows + 1).count() <= max_full_rows):
        return df
    if strategy == "recent":
        date_col = date_col or detect_date_column(df)
        if date_col:
            return df.orderBy(F.col(date_col).desc_nulls_last(), *key).limit(n)
        strategy = "random"
    if strategy == "stratified":
        return stratified_rows(df, n, stratify_col, key, seed)
    if strategy == "random":
        return random_rows(df, n, key, seed)
    if strategy in ("head", "tail"):
        order = [F.col(k) if strategy == "head" else F.col(k).desc() for k in key]
        return df.orderBy(*order).limit(n)
    raise ValueError(f"unknown strategy {strategy}")


def sample_summary(table: str, source: DataFrame, sampled: DataFrame) -> DataFrame:
    """Sampled and source row counts in one row."""
    marked = source.agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("side"), "n").unionByName(
        sampled.agg(F.count(F.lit(1)).alias("n")).select(F.lit("sample").alias("side"), "n"))
    return marked.agg(
        F.lit(table).alias("table_name"),
        F.max(F.when(F.col("side") == "sample", F.col("n"))).alias("sampled_rows"),
        F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source_rows"),
    )


def dedup(
    df: DataFrame,
    keys: Sequence[str],
    strategy: str = "first",
    *,
    order_by: Sequence[str],
    ranking: str | None = None,
    desc: bool = True,
) -> DataFrame:
    """One row per key: first, last, or best by a ranking column.

    Spark keeps one row per key in each map task before the shuffle."""
    order = order_columns(order_by)
    if strategy == "last":
        order = order_columns([o[1:] if o.startswith("-") else "-" + o for o in order_by])
    elif strategy == "ranking" and ranking:
        rank = F.col(ranking).desc_nulls_last() if desc else F.col(ranking).asc_nulls_last()
        order = [rank, *order]
    return top_per_group(df, keys, order, 1)


def dedup_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("original"),
        F.count(F.lit(1)).alias("final"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
    )
