"""Joins beyond plain equi-joins, without cross products.

Equi-joins are left to Catalyst and AQE (broadcast by measured size, skewed
shuffle partitions split at run time).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import running

PAGE_ROWS = 10_000


def lookup(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, out: str,
    *, order_by: Sequence[str], page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Left outer lookup: matches as an array of structs per left row.

    Matches are collected in pages of ``page_rows`` (column ``page``), so a key
    with any number of matches keeps all of them without an unbounded array;
    a key with at most ``page_rows`` matches has the single page 0.
    """
    numbered = running(right, [right_on], order_by, position="_pos")
    item = F.struct("_pos", *[c for c in right.columns])
    pages = (
        numbered.withColumn("page", F.floor((F.col("_pos") - 1) / page_rows))
        .groupBy(right_on, "page")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(
            F.col(right_on).alias("_key"), "page",
            F.transform("_items", lambda s: s.dropFields("_pos")).alias(out),
        )
    )
    joined = left.join(pages, F.col(left_on) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({"page": F.coalesce("page", F.lit(0)), out: F.coalesce(out, F.array().cast(pages.schema[out].dataType))})


def referential_violations(source: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Non-null source values that the target lacks, with their row counts."""
    values = source.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return values.join(target.select(F.col(target_column).alias("value")), "value", "left_anti")


def referential_report(rules: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """One row per rule: violating values and whether the rule holds."""
    rows = [
        referential_violations(*args).agg(F.count(F.lit(1)).alias("missing")).select(F.lit(name).alias("rule"), "missing")
        for name, args in rules.items()
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("consistent", F.col("missing") == 0)


def count_below(left: DataFrame, right: DataFrame, left_value: str, right_value: str, out: str, *, key: Sequence[str]) -> DataFrame:
    """Theta join reduced to what is asked of it: per left row the number of right
    rows with a smaller value.  One ordered pass replaces the pairs."""
    fields = left.columns
    marks = right.where(F.col(right_value).isNotNull()).groupBy(F.col(right_value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    both = left.select(*fields, F.col(left_value).alias("_v"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n")).unionByName(
        marks.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # equal values: the left row sorts first, so only strictly smaller ones count
    cum = running(both, [], ["_v", "_side", *key], sums={out: F.col("_n")})
    return cum.where("_side = 0").select(*fields, out)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
    values: Sequence[str], *, left_key: Sequence[str], right_key: Sequence[str],
) -> DataFrame:
    """Latest right row at or before the left time, per key; null when there is none."""
    fields = left.columns
    l = left.select(*fields, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left_key).cast("string").alias("_k"))
    r = right.select(
        *keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
        F.to_json(F.struct(*right_key)).alias("_k"), F.struct(*values).alias("_match"))
    both = l.unionByName(r, allowMissingColumns=True)
    out = running(both, keys, ["_t", "_side", "_k"], lasts={"_match": F.col("_match")})
    return out.where("_side = 1").select(*fields, *[F.col(f"_match.{v}").alias(v) for v in values])


def range_join(
    points: DataFrame, intervals: DataFrame, point: Column, start: Column, stop: Column, width: float,
    *, keys: Sequence[str] = (), point_id: Column,
) -> DataFrame:
    """Points inside [start, stop] per key: equi-join on ``floor(x / width)`` buckets
    plus the exact test.  Buckets holding more than a fair share of the points are
    salted: points spread over the salts, intervals are repeated for each."""
    p = points.withColumn("_x", point).withColumn("_b", F.floor(F.col("_x") / width))
    i = intervals.withColumns({"_lo": start, "_hi": stop}).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    sizes = p.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > HOT_ROWS).select(*keys, "_b", F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_s"))
    p, i = salt(p, i, hot, [*keys, "_b"], point_id)
    joined = p.join(i, [*keys, "_b", "_salt"])
    return joined.where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).drop("_x", "_b", "_lo", "_hi", "_salt")


HOT_ROWS = 1_000_000


def salt(big: DataFrame, other: DataFrame, hot: DataFrame, keys: Sequence[str], row_id: Column) -> tuple[DataFrame, DataFrame]:
    """Spread the rows of hot keys over ``_s`` salts and repeat the other side to match.

    ``hot`` (keys, _s) has at most rows / HOT_ROWS entries; AQE decides from its
    measured size whether it is broadcast.
    """
    big = big.join(hot, list(keys), "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_s")), F.lit(0)).cast("int")).drop("_s")
    other = other.join(hot, list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_s"), F.lit(1)) - 1))).drop("_s")
    return big, other


def inclusion_dependencies(columns: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Foreign-key candidates ``child -> parent``: every distinct child value occurs in
    the parent and the parent column is unique.

    All columns share one shuffle by value; a value carries the (schema-bounded)
    list of columns that hold it, and only counts per column pair remain.
    """
    tagged = reduce(DataFrame.unionByName, [
        df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("col"), "v", "n")
        for name, (df, c) in columns.items()
    ])
    per_value = tagged.groupBy("v").agg(F.collect_list(F.struct("col", "n")).alias("cols"))
    children = per_value.select(F.explode("cols").alias("c"), "cols").select(F.col("c.col").alias("child"), F.col("c.n").alias("n"), "cols")
    shares = children.select("child", "n", F.explode("cols.col").alias("parent"))
    counts = shares.groupBy("child", "parent").agg(F.count(F.lit(1)).alias("shared"), F.sum("n").alias("rows"))
    own = counts.where("child = parent")
    distinct = own.select(F.col("child"), F.col("shared").alias("child_values"))
    unique = own.where(F.col("shared") == F.col("rows")).select(F.col("parent"))
    return (
        counts.where("child <> parent").join(distinct, "child").where("shared = child_values")
        .join(unique, "parent").select("child", "parent", "child_values")
    )
