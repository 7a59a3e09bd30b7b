"""Exact order statistics by selection: values at given ranks without sorting a group.

Every value has one of about 65,000 buckets by an order-preserving rule on sign and
magnitude.  One scan counts the buckets of each group (tasks combine first, so a hot
group sends a bucket once per task).  The counts tell which buckets hold the wanted
ranks; a second scan takes the rows of these buckets alone and counts their values.
Deviations from the median are bounded from the same counts: a bucket lies between
two deviations, and only buckets between the bounds of the wanted rank are read.

Raw rows meet tables of groups times ranks, never one another, and no window is
larger than a group's buckets or a bucket's distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordered import null_safe_join, running
from tidemark.session import MAX_GROUP_ROWS, conf_int, materialize

#: buckets per doubling of the magnitude; the 2,099 doublings of a double fill 31,485 per sign
PER_DOUBLING = 15
_X, _B, _ALL = "_tm_x", "_tm_bucket", "_tm_all"


def bucket(x: Column) -> Column:
    """Order-preserving bucket of a number; zero has its own, as have the infinities and NaN."""
    d = x.cast("double")
    size = F.floor((F.log2(F.abs(d)) + 1075) * PER_DOUBLING).cast("int") + 1
    out = F.when(d > 0, size).otherwise(-size)
    return F.when(F.isnan(d), 32_767).when(d == 0, 0).when(F.abs(d) == float("inf"), F.when(d > 0, 32_766).otherwise(-32_766)).otherwise(out)


class Selection:
    """Bucket counts of one column, by group, from which ranks are found."""

    def __init__(self, df: DataFrame, keys: Sequence[str], column: str):
        x = F.col(column)
        self.keys, self.column = list(keys), column
        self.ks = self.keys or [_ALL]
        rows = df.where(x.isNotNull()).select(*self.keys, x.alias(_X), bucket(x).alias(_B))
        self.rows = rows if keys else rows.withColumn(_ALL, F.lit(1))
        counts = self.rows.groupBy(*self.ks, _B).agg(F.count(F.lit(1)).alias("_n"), F.min(_X).alias("_lo"), F.max(_X).alias("_hi"))
        group = W.partitionBy(*self.ks)
        upto = F.sum("_n").over(group.orderBy(_B).rowsBetween(W.unboundedPreceding, W.currentRow))
        self.counts = materialize(counts.select("*", upto.alias("_upto"), F.sum("_n").over(group).alias("_total")), "buckets")
        self.limit = conf_int(df.sparkSession, MAX_GROUP_ROWS)

    def at(self, ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
        """Keys, ``_total`` and, by name, the value at each rank (from 0, given the group's size)."""
        total = F.col("_total")
        wanted = F.array_distinct(F.array(*[r(total).cast("long") for r in ranks.values()]))
        inside = F.filter(wanted, lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))
        held = self.counts.withColumn("_in", inside).where(F.size("_in") > 0).withColumn("_before", F.col("_upto") - F.col("_n"))
        held = held.select(*self.ks, _B, "_n", "_lo", "_hi", "_total", "_before", "_in")
        # without keys there are no more rows than ranks
        held = materialize(held, "wanted") if self.keys else held.sparkSession.createDataFrame(held.collect(), held.schema)
        found = held.where("_lo = _hi").select(*self.ks, "_total", F.explode("_in").alias("_rank"), F.col("_lo").alias("_value"))
        open_ = held.where("_lo < _hi")
        most = open_.agg(F.max("_n")).first()[0]
        if most is not None:
            near = null_safe_join(self.rows, open_.select(*self.ks, _B), [*self.ks, _B], "left_semi")
            values = near.groupBy(*self.ks, _B, _X).agg(F.count(F.lit(1)).alias("_c"))
            cum = running(values, [*self.ks, _B], [_X], sums={"_cum": F.col("_c")}, fits=most <= self.limit)
            met = null_safe_join(cum, open_.select(*self.ks, _B, "_total", "_before", "_in"), [*self.ks, _B])
            last = F.col("_before") + F.col("_cum")
            hits = F.filter("_in", lambda r: (r >= last - F.col("_c")) & (r < last))
            found = found.unionByName(met.select(*self.ks, "_total", F.explode(hits).alias("_rank"), F.col(_X).alias("_value")))
        each = found.groupBy(*self.ks).agg(F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
        return each.select(*self.keys, "_total", *[F.try_element_at("_at", r(total).cast("long")).alias(n) for n, r in ranks.items()])

    def deviation(self, medians: DataFrame, out: str) -> DataFrame:
        """Keys and the median distance to the group's median ``_med``."""
        if not self.keys:
            medians = medians.withColumn(_ALL, F.lit(1))
        lo, hi, med, n = (F.col(c) for c in ("_lo", "_hi", "_med", "_n"))
        least = F.when(lo >= med, lo - med).when(hi <= med, med - hi).otherwise(0.0)
        b = null_safe_join(self.counts, medians.select(*self.ks, "_med"), self.ks).withColumns({"_least": least, "_most": F.greatest(F.abs(lo - med), F.abs(hi - med))})
        low, high = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
        group, past = W.partitionBy(*self.ks), W.unboundedPreceding
        b = b.withColumns({
            "_under": F.coalesce(F.sum(n).over(group.orderBy("_least").rowsBetween(past, -1)), F.lit(0)),
            "_done": F.sum(n).over(group.orderBy("_most").rowsBetween(past, W.currentRow)),
        })
        # fewer rows than wanted lie below _from, more than wanted up to _to
        b = b.withColumns({
            "_from": F.max(F.when(F.col("_under") <= low, F.col("_least"))).over(group),
            "_to": F.min(F.when(F.col("_done") > high, F.col("_most"))).over(group),
        })
        b = b.withColumn("_skip", F.coalesce(F.sum(F.when(F.col("_most") < F.col("_from"), n)).over(group), F.lit(0)))
        near = b.where((F.col("_most") >= F.col("_from")) & (F.col("_least") <= F.col("_to")))
        near = materialize(near.select(*self.ks, _B, "_n", "_med", "_skip", "_total"), "near-median")
        most = near.groupBy(*self.ks).agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 0
        rows = null_safe_join(self.rows, near.select(*self.ks, _B, "_med", "_skip", "_total"), [*self.ks, _B])
        values = rows.groupBy(*self.ks, F.abs(F.col(_X) - F.col("_med")).alias("_d")).agg(F.count(F.lit(1)).alias("_c"), F.max("_skip").alias("_skip"), F.max("_total").alias("_total"))
        cum = running(values, self.ks, ["_d"], sums={"_cum": F.col("_c")}, fits=most <= self.limit)
        last = F.col("_skip") + F.col("_cum")
        pick = lambda rank: F.min(F.when(last > rank, F.col("_d")))
        two = cum.groupBy(*self.ks).agg(pick(low).alias("_a"), pick(high).alias("_b"), F.max("_total").alias("_total"))
        return two.select(*self.keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * 0.5).alias(out))


def interpolated(name: str, p: float) -> tuple[dict[str, Callable[[Column], Column]], Column]:
    """The two ranks that a quantile needs, and its value from them."""
    at = lambda n: F.lit(float(p)) * (n - 1)
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    position = at(F.col("_total"))
    value = lo + F.when(hi == lo, 0.0).otherwise((hi - lo) * (position - F.floor(position)))
    return {f"{name}_lo": lambda n: F.floor(at(n)), f"{name}_hi": lambda n: F.ceil(at(n))}, value


def nearest(p: float) -> Callable[[Column], Column]:
    """Rank min(floor(p * n), n - 1)."""
    return lambda n: F.least(F.floor(F.lit(float(p)) * n), n - 1)
