"""Personal-data detection, subject rights and row-level access over tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.privacy import PATTERNS, SCAN_PATTERNS, redact_value
from tidemark.session import spread


def spans(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """One row per match: type, value, 0-based start, length, confidence.

    Starts come from the lengths of the gaps and matches before each match, so
    the whole text is scanned inside the JVM."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))

    def found(name: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
        gaps = F.split(F.col(column), pattern, -1)
        return F.transform(hits, lambda m, i: F.struct(
            F.lit(name).alias("type"), m.alias("value"),
            (total(F.slice(gaps, F.lit(1), i + 1)) + total(F.slice(hits, F.lit(1), i))).alias("start"),
            F.length(m).alias("length"), F.lit(0.95).alias("confidence")))

    every = F.flatten(F.array(*[found(n, p) for n, p in PATTERNS.items()]))
    texts = spread(df.where(F.col(column).isNotNull()).select(*key, column))
    return texts.select(*key, F.inline(every))


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _per_column(df: DataFrame, columns: Sequence[str], measures: Mapping[str, "callable"]) -> DataFrame:
    """All measures of all columns in one aggregate, then one row per column."""
    wide = spread(df.select(*columns)).agg(*[m(F.col(c)).alias(f"{c}__{n}") for c in columns for n, m in measures.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").alias(n) for n in measures]) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def analyze_columns(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.5) -> DataFrame:
    """Rows matching each type per column; likely types reach ``share`` of all rows."""
    columns = columns or _string_columns(df)
    counts = {n: (lambda c, p=p: F.count_if(c.rlike(p))) for n, p in PATTERNS.items()}
    out = _per_column(df, columns, {"total": lambda c: F.count(F.lit(1))} | counts)
    likely = F.array_compact(F.array(*[F.when(F.col(n) >= F.col("total") * share, n) for n in PATTERNS]))
    first = F.coalesce(*[F.when(F.col(n) >= F.col("total") * share, F.col(n) / F.col("total") * 100) for n in PATTERNS])
    return out.withColumns({"likely": F.array_join(likely, ","), "percentage": first})


def scan_table(df: DataFrame, table: str) -> DataFrame:
    """Columns that hold personal data: types, confidence and matching rows over the whole table."""

    def any_type(c: Column) -> Column:
        return reduce(lambda a, b: a | b, [c.rlike(p) for p in SCAN_PATTERNS.values()])

    counts = {n: (lambda c, p=p: F.count_if(c.rlike(p))) for n, p in SCAN_PATTERNS.items()}
    out = _per_column(df, _string_columns(df), {"filled": F.count, "matches": lambda c: F.count_if(any_type(c))} | counts)
    types = F.array_join(F.array_compact(F.array(*[F.when(F.col(n) > 0, n) for n in SCAN_PATTERNS])), ",")
    return out.where("matches > 0").select(
        F.lit(table).alias("table_name"), "column", types.alias("types"), "matches",
        (F.col("matches") / F.col("filled") * 100).alias("confidence"))


def redact(df: DataFrame, columns: Sequence[str], strategy: str, key: Column | None = None) -> DataFrame:
    return df.withColumns({c: redact_value(F.col(c), strategy, key) for c in columns})


def subject_export(tables: Mapping[str, tuple[DataFrame, str]], subject) -> DataFrame:
    """All rows of one subject over several tables as (table_name, record JSON)."""
    parts = [
        df.where(F.col(c) == subject).select(F.lit(name).alias("table_name"), F.to_json(F.struct("*")).alias("record"))
        for name, (df, c) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def subject_erasure(df: DataFrame, column: str, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table without the subjects' rows, and the number of rows removed."""
    ids = subjects.select(F.col(subjects.columns[0]).alias(column)).distinct()
    return df.join(ids, column, "left_anti"), df.join(ids, column, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def latest_records(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Latest value set per key from an append-only log."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return best.select(*keys, "_v.*")


def rows_for(df: DataFrame, user, roles: Sequence[str], *, owner: str, department: str, memberships: DataFrame) -> DataFrame:
    """admin: all rows; manager: rows of own departments; anyone else: own rows.

    ``memberships`` holds (user, department)."""
    if "admin" in roles:
        return df
    if "manager" in roles:
        mine = memberships.where(F.col("user") == user).select(F.col("department").alias(department)).distinct()
        return df.join(mine, department, "left_semi").select(*df.columns)
    return df.where(F.col(owner) == user)


def encrypt_column(df: DataFrame, column: str, keys: DataFrame, key_id: str, out: str) -> DataFrame:
    """AES-CBC with a random IV, Base64.  Keys come from a key table (key_id, secret),
    so no secret appears in a plan.  A value whose key is unknown stops the job:
    it must not get lost as a null."""
    secret = F.aes_encrypt(F.col(column).cast("string"), _known_secret(column, key_id), F.lit("CBC"))
    return df.join(keys, key_id, "left").withColumn(out, F.base64(secret)).drop("secret")


def decrypt_column(df: DataFrame, column: str, keys: DataFrame, key_id: str, out: str) -> DataFrame:
    plain = F.aes_decrypt(F.unbase64(column), _known_secret(column, key_id), F.lit("CBC")).cast("string")
    return df.join(keys, key_id, "left").withColumn(out, plain).drop("secret")


def _known_secret(column: str, key_id: str) -> Column:
    unknown = F.col("secret").isNull() & F.col(column).isNotNull()
    return F.when(unknown, F.raise_error(F.concat(F.lit("no encryption key "), F.coalesce(F.col(key_id).cast("string"), F.lit("null")))).cast("string")).otherwise(F.col("secret"))
