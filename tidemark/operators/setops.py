"""Table comparison and keyed sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import full_null_safe_join


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``only_first`` / ``only_second`` / ``different`` rows by key, null equal to
    null; equal rows are left out."""
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(F.lit(True).alias("_in"), *values).alias("_a"))
    right = b.select(*keys, F.struct(F.lit(True).alias("_in"), *values).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "only_first")
        .when(F.col("_a").isNull(), "only_second")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    )
    return full_null_safe_join(left, right, keys).select(*keys, status.alias("status")).where("status is not null")


def members_of(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows whose value is a member of the one-column set."""
    return df.join(members.select(F.col(members.columns[0]).alias(column)), column, "left_semi")


def add_members(members: DataFrame, more: DataFrame) -> DataFrame:
    return members.union(more).distinct()


def set_members(df: DataFrame, set_key: str, member: str) -> DataFrame:
    """Members of each set as rows, so a set of any size stays distributed."""
    return df.select(set_key, member).where(F.col(member).isNotNull()).distinct()


def top_values(df: DataFrame, column: Column | str, k: int = 10) -> DataFrame:
    """Most frequent values, ties by value."""
    c = F.col(column) if isinstance(column, str) else column
    counts = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(k)
