"""Pivot, unpivot, cross-tab, transpose and composable document stages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quantiles
from tidemark.operators.ordered import group_fits, null_safe_join

AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": lambda c: F.sum(c),
    "average": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count": lambda c: F.nullif(F.count(c), F.lit(0)),
    "median": lambda c: F.median(c),
    "stddev": lambda c: F.stddev_pop(c),
}


def pivot_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct pivot labels; their number is the width of the result and
    Spark refuses more than spark.sql.pivotMaxValues, so this list is bounded."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = df.select(F.coalesce(F.col(column).cast("string"), F.lit("NULL")).alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values to pivot")
    return sorted(r.v for r in rows)


def pivot(
    df: DataFrame, keys: Sequence[str], column: str, values: Mapping[str, str],
    labels: Sequence[str] | None = None, order_by: Sequence[str] = (),
) -> DataFrame:
    """One column per pivot label and value column; ``{value: aggregate}``.

    ``first`` / ``last`` take the row that is first / last by ``order_by``.
    A null label becomes ``NULL``; several values give ``{label}_{value}``.
    """
    labels = labels or pivot_values(df, column)

    def expr(value: str, how: str) -> Column:
        if how in ("first", "last"):
            return (F.min_by if how == "first" else F.max_by)(value, F.struct(*order_by))
        return AGGREGATES[how](value)

    marked = df.withColumn("_pivot", F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
    if "median" in values.values() and not group_fits(marked, [*keys, "_pivot"]):
        return _pivot_large(marked, keys, values, labels, expr)
    aggs = [expr(v, how).alias(v) for v, how in values.items()]
    return marked.groupBy(*keys).pivot("_pivot", list(labels)).agg(*aggs)


def _pivot_large(marked: DataFrame, keys: Sequence[str], values: Mapping[str, str], labels: Sequence[str], expr) -> DataFrame:
    """Pivot with medians of groups too large for one task: aggregate per cell first."""
    cell = [*keys, "_pivot"]
    plain = [expr(v, how).alias(v) for v, how in values.items() if how != "median"]
    cells = marked.groupBy(*cell).agg(*(plain or [F.lit(1).alias("_one")]))
    for v, how in values.items():
        if how == "median":
            cells = null_safe_join(cells, quantiles(marked, cell, v, [0.5]).withColumnRenamed("q0", v), cell, "left")
    return cells.groupBy(*keys).pivot("_pivot", list(labels)).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], key: str = "attribute", value: str = "value") -> DataFrame:
    """Columns to rows, null values kept."""
    return df.unpivot(list(keep), list(columns), key, value)


def crosstab(df: DataFrame, row: str, column: str, labels: Sequence[str] | None = None) -> DataFrame:
    grouped = df.withColumn("_pivot", F.coalesce(F.col(column).cast("string"), F.lit("NULL"))).groupBy(row)
    return grouped.pivot("_pivot", list(labels or pivot_values(df, column))).count().na.fill(0)


def transpose(df: DataFrame, order_by: Sequence[str], max_rows: int = 500) -> DataFrame:
    """One row per column, ``Row0..RowN`` in the given order.

    The row count becomes the width of the result: more than ``max_rows`` is an
    error, never a cut.
    """
    rows = df.orderBy(*order_by).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows to transpose")
    cells = df.select(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in order_by]).alias("_at"),
                      F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])))
    at = ["\x1f".join(str(r[c]) for c in order_by) for r in rows]
    wide = cells.groupBy("column").pivot("_at", at).agg(F.first("v"))
    return wide.toDF("column", *[f"Row{i}" for i in range(len(at))])


class Stages:
    """Document pipeline: each method returns the next stage of one lazy plan."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _next(self, df: DataFrame) -> "Stages":
        return Stages(df)

    def match(self, condition: Column | str) -> "Stages":
        return self._next(self.df.where(condition))

    def group(self, by: str, **accumulators: Column) -> "Stages":
        return self._next(self.df.groupBy(F.col(by).alias("_id")).agg(*[c.alias(n) for n, c in accumulators.items()]))

    def sort(self, *order: Column | str) -> "Stages":
        return self._next(self.df.orderBy(*order))

    def limit(self, n: int) -> "Stages":
        return self._next(self.df.limit(n))

    def skip(self, n: int) -> "Stages":
        return self._next(self.df.offset(n))

    def project(self, *columns: Column | str) -> "Stages":
        return self._next(self.df.select(*columns))

    def add_fields(self, **fields: Column) -> "Stages":
        return self._next(self.df.withColumns(fields))

    def unwind(self, column: str) -> "Stages":
        return self._next(self.df.withColumn(column, F.explode(column)))

    def bucket(self, column: str, boundaries: Sequence[float]) -> "Stages":
        from tidemark.operators.aggregates import bucket_counts

        return self._next(bucket_counts(self.df, column, boundaries))

    def lookup(self, other: DataFrame, left_on: str, right_on: str, out: str, order_by: Sequence[str]) -> "Stages":
        from tidemark.operators.joins import lookup

        return self._next(lookup(self.df, other, left_on, right_on, out, order_by=order_by))


def transform_all(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda d, f: d.transform(f), steps, df)
