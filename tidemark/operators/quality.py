"""Profiling, quality metrics, validation, schema inference, mapping and drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import DATE_FORMATS, DATE_LIKE, DAY_OR_MONTH_FIRST, name_similarity, parse_date, type_tests
from tidemark.operators.aggregates import nearest_ranks, quantiles
from tidemark.operators.ordered import top_per_group
from tidemark.session import spread


def _long(df: DataFrame, columns: Sequence[str], cast: str = "string") -> DataFrame:
    """(column, value) rows of the chosen columns."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns])))


def _rows(df: DataFrame, columns: Sequence[str], measures: Mapping[str, "callable"]) -> DataFrame:
    wide = df.agg(*[m(F.col(c)).alias(f"{c}__{n}") for c in columns for n, m in measures.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").alias(n) for n in measures]) for c in columns])))


def column_value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per (column, value), the shared base of distinct counts and top values."""
    long = _long(df, columns or df.columns).where("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Per column: rows, nulls, null %, distinct non-null values, unique %."""
    base = {"total": lambda c: F.count(F.lit(1)), "nulls": lambda c: F.count_if(c.isNull())}
    if approximate:
        out = _rows(df, df.columns, base | {"distinct": F.approx_count_distinct})
    else:
        distinct = column_value_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        out = _rows(df, df.columns, base).join(distinct, "column", "left").na.fill(0, ["distinct"])
    pct = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0)
    return out.withColumns({"null_pct": pct("nulls"), "unique_pct": pct("distinct")})


def type_classes(df: DataFrame) -> DataFrame:
    """Numeric, Date, Boolean or String per column.  Text columns are judged by all
    their non-null values; a column without values is Unknown."""
    kinds = {f.name: f.dataType for f in df.schema}

    def klass(c: str) -> Column:
        t = kinds[c]
        if isinstance(t, T.NumericType):
            return F.lit("Numeric")
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit("Date")
        if isinstance(t, T.BooleanType):
            return F.lit("Boolean")
        v, tests = F.col(c), type_tests(F.col(c))
        n = F.count(v)
        numeric = F.count_if(tests["Decimal"])
        dates = F.count_if(tests["DateTime"])
        return F.when(n == 0, "Unknown").when(numeric == n, "Numeric").when(dates == n, "Date").otherwise("String")

    wide = df.agg(*[klass(c).alias(c) if isinstance(kinds[c], T.StringType) else F.max(klass(c)).alias(c) for c in df.columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("class")) for c in df.columns])))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean, population deviation and variance, upper median."""
    m = {"lo": F.min, "hi": F.max, "mean": F.avg, "sd": F.stddev_pop, "var": F.var_pop}
    stats = _rows(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns, m)
    return stats.join(nearest_ranks(_long(df, columns, "double"), ["column"], "value", {"median": 0.5}), "column", "left")


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = {"min_len": lambda c: F.min(F.length(c)), "max_len": lambda c: F.max(F.length(c)), "avg_len": lambda c: F.avg(F.length(c))}
    return _rows(df, columns, m)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Most frequent values per column, ties by value."""
    return top_per_group(column_value_counts(df, columns), ["column"], [F.desc("n"), F.col("value")], k)


def date_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First and last moment and the range in seconds."""
    sec = lambda c: F.unix_timestamp(c.cast("timestamp"))
    m = {"first": F.min, "last": F.max, "range_seconds": lambda c: F.max(sec(c)) - F.min(sec(c))}
    return _rows(df, columns, m)


@dataclass(frozen=True)
class QualityRules:
    min_completeness: float = 95.0
    min_validity: float = 95.0
    unique: Sequence[str] = ()
    valid: Mapping[str, Column] = field(default_factory=dict)
    references: Mapping[str, tuple[str, DataFrame, str]] = field(default_factory=dict)


def quality_report(df: DataFrame, rules: QualityRules) -> DataFrame:
    """(metric, value, severity): completeness, uniqueness, validity, consistency and
    ``overall_score``, their mean.  Severity is set where a threshold is missed."""
    cells = reduce(lambda a, b: a + b, [F.count(c) for c in df.columns])
    exprs = [(cells / (F.count(F.lit(1)) * len(df.columns)) * 100).alias("completeness")]
    exprs += [(F.avg(F.coalesce(p, F.lit(False)).cast("int")) * 100).alias(f"validity_{c}") for c, p in rules.valid.items()]
    scalars = df.agg(*exprs)
    names = list(scalars.columns)
    metrics = scalars.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    for c in rules.unique:  # a null counts as one value
        seen = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        metrics = metrics.unionByName(seen.agg((F.count(F.lit(1)) / F.sum("n") * 100).alias("value")).withColumn("metric", F.lit(f"uniqueness_{c}")))
    consistency = None
    for c, target, tc in rules.references.values():
        missing = df.where(F.col(c).isNotNull()).select(F.col(c).alias("v")).join(target.select(F.col(tc).alias("v")), "v", "left_anti")
        passed = missing.agg((F.count(F.lit(1)) == 0).cast("double").alias("ok"))
        consistency = passed if consistency is None else consistency.union(passed)
    if consistency is None:
        metrics = metrics.unionByName(df.sparkSession.range(1).select(F.lit("consistency").alias("metric"), F.lit(100.0).alias("value")))
    else:
        metrics = metrics.unionByName(consistency.agg((F.avg("ok") * 100).alias("value")).withColumn("metric", F.lit("consistency")))
    v, m = F.col("value"), F.col("metric")
    severity = (
        F.when((m == "completeness") & (v < rules.min_completeness), "High")
        .when(m.startswith("uniqueness_") & (v < 100), "Medium")
        .when(m.startswith("validity_") & (v < rules.min_validity), "Medium")
    )
    scored = metrics.withColumn("severity", severity)
    # total row and metric rows from the same pass
    sets = scored.groupingSets([[m, F.col("severity")], []], m, F.col("severity"))
    return sets.agg(F.avg("value").alias("value"), F.grouping_id().alias("_g")).select(
        F.when(F.col("_g") > 0, "overall_score").otherwise(m).alias("metric"), "value", "severity")


@dataclass(frozen=True)
class Rule:
    """required, range (lo, hi), pattern, length (lo, hi) or custom (predicate)."""

    column: str
    kind: str
    lo: float | None = None
    hi: float | None = None
    pattern: str | None = None
    predicate: Column | None = None
    severity: str = "Error"
    message: str = ""

    def passes(self) -> Column:
        c = F.col(self.column)
        if self.kind == "required":
            return c.isNotNull() & (F.trim(c.cast("string")) != "")
        if self.kind == "pattern":
            ok = c.cast("string").rlike(self.pattern)
        elif self.kind in ("range", "length"):
            x = F.length(c.cast("string")) if self.kind == "length" else c.cast("double")
            ok = F.lit(True)
            ok = ok & (x >= self.lo) if self.lo is not None else ok
            ok = ok & (x <= self.hi) if self.hi is not None else ok
        elif self.kind == "custom":
            ok = self.predicate
        else:
            raise ValueError(f"unknown rule {self.kind}")
        return c.isNull() | F.coalesce(ok, F.lit(False))

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}"


def _failures(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[
        F.when(~r.passes(), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.lit(r.message or f"{r.kind} check failed").alias("message"),
            F.lit(r.severity).alias("severity"), F.col(r.column).cast("string").alias("value")))
        for r in rules]))


def violations(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per failed rule and row."""
    return df.select(*key, F.inline(_failures(rules)))


def validation_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows with at least one violation are invalid; violations are reported beside them."""
    bad = F.size(_failures(rules)).alias("_bad")
    return df.select(bad).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_bad") == 0).alias("valid"), F.count_if(F.col("_bad") > 0).alias("invalid"),
        F.sum("_bad").alias("violations"), (F.count_if(F.col("_bad") == 0) / F.count(F.lit(1)) * 100).alias("pass_pct"))


CLASSES = ["Boolean", "Integer", "Decimal", "DateTime", "Guid", "Email", "Url", "Json"]


def infer_schema(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Inferred class, confidence, nullability and null count per text column.

    One aggregate of match counts per column.  The best share wins, ties by class
    order; below one half the column is String with confidence 1.  A column's dates
    count in the one form that most of its values have (``infer_dates`` tells which).
    """
    columns = columns or df.columns
    measures = {"total": lambda c: F.count(F.lit(1)), "filled": F.count}
    measures |= {k: (lambda c, k=k: F.count_if(type_tests(c)[k])) for k in CLASSES}
    df = spread(df)
    dates = _date_counts(df, columns).groupBy("column").agg(F.max("n").alias("_dates"))
    counts = _rows(df, columns, measures).join(dates, "column", "left").withColumn("DateTime", F.greatest("DateTime", "_dates"))
    best = F.greatest(*[F.col(k) for k in CLASSES])
    pick = F.coalesce(*[F.when(F.col(k) == best, k) for k in CLASSES])
    score = best / F.col("filled")
    return counts.select(
        "column",
        F.when(F.col("filled") == 0, "String").when(score < 0.5, "String").otherwise(pick).alias("inferred"),
        F.when(F.col("filled") == 0, 0.0).when(score < 0.5, 1.0).otherwise(score).alias("confidence"),
        (F.col("filled") < F.col("total")).alias("nullable"), (F.col("total") - F.col("filled")).alias("nulls"))


def _date_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, form, n: values of each date form but ISO.  Values that look like none
    leave behind one test, before the forms are tried."""
    like = _long(df, columns).where(F.col("value").rlike(DATE_LIKE))
    forms = F.array_compact(F.array(*[F.when(parse_date(F.col("value"), f).isNotNull(), f) for f in DATE_FORMATS]))
    return like.select("column", F.explode(forms).alias("form")).groupBy("column", "form").agg(F.count(F.lit(1)).alias("n"))


def infer_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, form, parsed, filled, ambiguous: the date form of most values per text column.

    All values of a column vote, so one day above twelve settles the order of day and
    month; where none does, both orders read the same values, the month-first form
    is given and ``ambiguous`` is true.  ISO forms are named ISO and win ties; a
    column without a date has no form."""
    columns = columns or df.columns
    forms = ["ISO", *DATE_FORMATS]
    df = spread(df)
    found = _date_counts(df, columns).groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("form", "n"))).alias("_n"))  # an entry per form
    counts = _rows(df, columns, {"filled": F.count, "iso": lambda c: F.count_if(type_tests(c)["DateTime"])}).join(found, "column", "left")
    n = {f: F.col("iso") if f == "ISO" else F.coalesce(F.try_element_at("_n", F.lit(f)), F.lit(0)) for f in forms}
    best = F.greatest(*n.values())
    form = F.when(best > 0, F.coalesce(*[F.when(n[f] == best, f) for f in forms]))
    other = F.coalesce(*[F.when((F.col("form") == f), n[o] == best) for f, o in DAY_OR_MONTH_FIRST.items()], F.lit(False))
    return counts.withColumn("form", form).select("column", "form", best.alias("parsed"), "filled", other.alias("ambiguous"))


def inferred_statistics(df: DataFrame, inferred: DataFrame) -> DataFrame:
    """Numeric columns: min, max, mean, median.  Text, e-mail and URL: lengths.  All: unique values."""
    cols = df.columns
    unique = column_value_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    num = lambda c: c.try_cast("double")
    stats = _rows(df, cols, {"lo": lambda c: F.min(num(c)), "hi": lambda c: F.max(num(c)), "mean": lambda c: F.avg(num(c)),
                             "min_len": lambda c: F.min(F.length(c)), "max_len": lambda c: F.max(F.length(c))})
    numbers = _long(df, cols).select("column", F.col("value").try_cast("double").alias("value"))
    med = quantiles(numbers, ["column"], "value", [0.5]).withColumnRenamed("q0", "median")
    out = inferred.join(stats, "column").join(unique, "column", "left").join(med, "column", "left")
    numeric, text = F.col("inferred").isin("Integer", "Decimal"), F.col("inferred").isin("String", "Email", "Url")
    return out.select("column", "inferred", "unique", *[F.when(numeric, F.col(c)).alias(c) for c in ("lo", "hi", "mean", "median")],
                      *[F.when(text, F.col(c)).alias(c) for c in ("min_len", "max_len")])


TARGET_TYPES = {"Boolean": "boolean", "Integer": "bigint", "Decimal": "decimal", "DateTime": "timestamp_ntz"}


def apply_schema(df: DataFrame, inferred: Mapping[str, str], scale: int = 12, dates: Mapping[str, str] | None = None) -> DataFrame:
    """Typed columns; values that do not parse go to the ``_rejected`` map.

    ``dates`` names the form of the DateTime columns that are not ISO (``infer_dates``).

    Decimals have 38 digits, ``scale`` of them behind the point, and may have
    grouping commas, as inference accepts them.  A number that these digits cannot
    hold exactly is rejected, not rounded."""

    def typed(c: str, kind: str) -> Column:
        if kind == "DateTime" and (dates or {}).get(c, "ISO") != "ISO":
            return parse_date(F.col(c), dates[c])
        if kind != "Decimal":
            return F.col(c).try_cast(TARGET_TYPES[kind])
        plain = F.replace(F.trim(c), F.lit(","), F.lit(""))
        whole = F.length(F.regexp_extract(plain, r"\.([0-9]*?)0*$", 1)) <= scale
        return F.when(whole, plain.try_cast(f"decimal(38,{scale})"))

    casts = {c: typed(c, k) for c, k in inferred.items() if k in TARGET_TYPES}
    bad = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & x.isNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c, x in casts.items()])))
    return df.select(*[casts[c].alias(c) if c in casts else F.col(c) for c in df.columns], bad.alias("_rejected"))


def map_schemas(source: DataFrame, target: Sequence[tuple[str, str]]) -> DataFrame:
    """Best target column per source column from (column, type) rows.

    Score = 0.7 * name similarity + 0.3 * (1 when the types agree, else 0.5); pairs
    of at least 0.5 map, ties go to the earlier target.  ``target`` is schema
    metadata, so the candidate list per row is bounded by its width.
    """
    options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("target"), F.lit(k).alias("ttype")) for i, (n, k) in enumerate(target)])
    pairs = source.select("column", "inferred", F.inline(options))
    score = 0.7 * name_similarity(F.col("column"), F.col("target")) + 0.3 * F.when(F.col("inferred") == F.col("ttype"), 1.0).otherwise(0.5)
    best = pairs.groupBy("column").agg(F.max_by(F.struct("target", score.alias("score")), F.struct(score, -F.col("i"))).alias("b"))
    keep = F.col("b.score") >= 0.5
    return best.select("column", F.when(keep, F.col("b.target")).alias("target"), F.when(keep, F.col("b.score")).alias("score"))


def schema_rows(df: DataFrame) -> DataFrame:
    """(ordinal, name, type, nullable, max_length) with lengths measured on the data."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.length(c)).alias(f"_l_{c}") for c in texts])
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                     F.lit(f.nullable).alias("nullable"), (F.col(f"_l_{f.name}") if f.name in texts else F.lit(None).cast("int")).alias("max_length"))
            for i, f in enumerate(df.schema)]
    return wide.select(F.inline(F.array(*rows)))


def schema_hash(df: DataFrame) -> str:
    import hashlib

    text = ";".join(f"{f.name}:{f.dataType.simpleString()}:{f.nullable}" for f in df.schema)
    return hashlib.sha256(text.encode()).hexdigest()


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """added / removed / modified columns between two ``schema_rows`` frames."""
    o = old.select("name", F.struct("type", "nullable", "max_length").alias("o"))
    n = new.select("name", F.struct("type", "nullable", "max_length").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return o.join(n, "name", "full").select("name", change.alias("change"), F.col("o.type").alias("old_type"), F.col("n.type").alias("new_type")).where("change is not null")
