"""Change detection and merge as DataFrame rewrites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import full_null_safe_join, null_safe_join


def detect_since(df: DataFrame, column: str, since=None) -> DataFrame:
    """Rows after the high-water mark of a timestamp, version or change-id column."""
    return df if since is None else df.where(F.col(column) > F.lit(since))


def high_water_mark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("mark"))


def latest_changes(changes: DataFrame, keys: Sequence[str], change_id: str) -> DataFrame:
    """The last change of each key.  max_by merges map-side, so a hot key is cheap."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), change_id).alias("_c")).select(*keys, "_c.*")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full compare: op I / U / D with the new values (old ones for deletes); null keys are equal."""
    values = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*values, F.lit(True).alias("_in")).alias("_o"))
    n = new.select(*keys, F.struct(*values, F.lit(True).alias("_in")).alias("_n"))
    op = F.when(F.col("_o").isNull(), "I").when(F.col("_n").isNull(), "D").when(~F.col("_o").eqNullSafe(F.col("_n")), "U")
    d = full_null_safe_join(o, n, keys).withColumn("op", op).where("op is not null")
    return d.select("op", *keys, F.coalesce("_n", "_o").alias("_v")).select("op", *keys, *[f"_v.{c}" for c in values])


def merge(
    target: DataFrame, source: DataFrame, keys: Sequence[str], *,
    update: Sequence[str] | None = None, action: str | None = None, when: Column | None = None,
) -> DataFrame:
    """Upsert: matched rows take the source values, unmatched source rows are inserted.

    With ``action``, source rows marked ``DELETE`` remove their match (and are
    ignored when unmatched).  ``when`` limits updates to matches it holds for; it
    may refer to ``t.<column>`` and ``s.<column>``.  Null keys are equal.  Several
    source rows for one key are an error, found in the shuffle that the join needs.
    """
    values = [c for c in target.columns if c not in keys]
    update = list(values if update is None else update)
    t = target.select(*keys, F.struct(F.lit(True).alias("_in"), *values).alias("t"))
    extra = [action] if action else []
    s = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(True).alias("_in"), *values, *extra)).alias("s"))
    kind = s.schema["s"].dataType
    s = s.select(*keys, F.when(F.col("_n") == 1, F.col("s")).otherwise(F.raise_error(F.lit("merge: several source rows for one key")).cast(kind)).alias("s"))
    both = full_null_safe_join(t, s, keys)
    matched = F.col("t").isNotNull() & F.col("s").isNotNull()
    if action:
        gone = F.coalesce(F.col(f"s.{action}") == "DELETE", F.lit(False))
        both = both.where(~gone)
    take = matched if when is None else matched & F.coalesce(when, F.lit(False))
    out = [
        F.when(F.col("t").isNull(), F.col(f"s.{c}")).when(take, F.col(f"s.{c}") if c in update else F.col(f"t.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        for c in values
    ]
    return both.select(*keys, *out).select(*target.columns)


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], *, op: str = "op", change_id: str = "change_id") -> tuple[DataFrame, DataFrame]:
    """Target after the last change per key, and counts by outcome.

    Inserting an existing key replaces it; deleting or updating a missing key
    counts as failed and changes nothing.  Null keys are equal; the target has one
    row per key."""
    last = latest_changes(changes, keys, change_id)
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    judged = null_safe_join(last, known, keys, "left").withColumn(
        "outcome", F.when((F.col(op) != "I") & F.col("_known").isNull(), "failed").otherwise("applied"))
    counts = judged.groupBy(op, "outcome").agg(F.count(F.lit(1)).alias("n"))
    good = judged.where("outcome = 'applied'")
    gone = good.select(*[F.col(k).alias(f"_g_{k}") for k in keys])
    kept = target.join(gone, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]), "left_anti")
    return kept.unionByName(good.where(F.col(op) != "D").select(*target.columns)), counts


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def retain(df: DataFrame, ts: str, days: int, now) -> DataFrame:
    """Drop rows older than ``days`` before ``now``; prunes files on a time-partitioned table."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))


def latest_state(log: DataFrame, key: str, at: str) -> DataFrame:
    """Current row per key of an append-only state table."""
    return latest_changes(log, [key], at)
