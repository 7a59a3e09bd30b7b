"""Scalar Columns: text similarity, JSON, dates, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def name_similarity(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length, ignoring case; two empty names are equal."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def json_get(c: Column, path: str) -> Column:
    """Value at a dotted object path as text; null when missing."""
    return F.get_json_object(c, "$." + path)


def json_flatten(df: DataFrame, key: Sequence[str], column: str, max_depth: int | None = None) -> DataFrame:
    """Leaves of a JSON text as (path, value): ``a.b`` for members, ``a[0]`` for items.

    One variant_explode per level, until no container is left; each level is
    stored, so a text is parsed once.  With ``max_depth``, containers below it are
    given back whole and marked ``open``.
    """
    level = df.select(*key, F.lit("").alias("path"), F.try_parse_json(column).alias("_v")).where("_v is not null")
    kind = F.regexp_extract(F.schema_of_variant("_v"), r"^(OBJECT|ARRAY)", 1)
    level, out, depth = materialize(level.withColumn("_k", kind), "json"), None, 0
    while True:
        leaf = level.where("_k = ''").select(*key, "path", F.variant_get("_v", "$", "string").alias("value"), F.lit(False).alias("open"))
        out = leaf if out is None else out.unionByName(leaf)
        deeper = level.where("_k <> ''")
        if deeper.isEmpty():
            return out
        if depth == max_depth:
            return out.unionByName(deeper.select(*key, "path", F.to_json("_v").alias("value"), F.lit(True).alias("open")))
        depth += 1
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        own = [F.col(f"_key.{c}") for c in key]
        parts = deeper.select(F.struct(*key).alias("_key"), "path", "_v").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        level = materialize(parts.select(*own, path.alias("path"), F.col("value").alias("_v")).withColumn("_k", kind), "json")


def json_edit(c: Column, edits: Sequence[tuple]) -> Column:
    """Top-level edits in order: ("add"|"replace", key, json), ("remove", key),
    ("rename", old, new).  Renaming an absent key changes nothing; keys come out sorted."""
    m = F.from_json(c, "map<string,variant>")
    for op, key, *rest in edits:
        if op in ("add", "replace"):
            m = F.map_concat(_without(m, key), F.create_map(F.lit(key), F.parse_json(F.lit(rest[0]))))
        elif op == "remove":
            m = _without(m, key)
        elif op == "rename":
            m = _renamed(m, key, rest[0])
        else:
            raise ValueError(f"unknown edit {op}")
    by_key = F.array_sort(F.map_keys(m))
    return F.to_json(F.map_from_arrays(by_key, F.transform(by_key, lambda k: F.element_at(m, k))))


def _without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def _renamed(m: Column, old: str, new: str) -> Column:
    moved = F.create_map(F.lit(new), F.element_at(m, F.lit(old)))
    return F.when(F.map_contains_key(m, old), F.map_concat(_without(m, old, new), moved)).otherwise(m)


def date_parts(ts: Column) -> dict[str, Column]:
    """Hour, day of week (Sunday = 0), month, quarter, day, weekend flag."""
    return {
        "hour": F.hour(ts), "day_of_week": F.dayofweek(ts) - 1, "month": F.month(ts), "quarter": F.quarter(ts),
        "day": F.dayofmonth(ts), "is_weekend": F.dayofweek(ts).isin(1, 7),
    }


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the fixed-width bucket (from the epoch) as epoch seconds."""
    s = F.unix_timestamp(ts.cast("timestamp"))
    return s - F.pmod(s, F.lit(seconds))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 when a norm is 0; an error when the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector lengths differ")).cast("double")).otherwise(value)


# Words read as booleans, and the e-mail shape.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
GUID = r"^[{(]?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}[)}]?$"
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)?(\.[0-9]*)?\s*$"
DATETIME = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?\s*$"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"


# Date forms beside the ISO one, in tie order, and the shape of each.
DATE_FORMATS = {
    "M/d/yyyy": r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "d/M/yyyy": r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "d.M.yyyy": r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    "M-d-yyyy": r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
    "d-M-yyyy": r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
    "yyyy/M/d": r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}",
    "d MMM yyyy": r"[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}",
    "MMM d, yyyy": r"[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}",
    "d MMMM yyyy": r"[0-9]{1,2} [A-Z][a-z]{2,8} [0-9]{4}",
    "MMMM d, yyyy": r"[A-Z][a-z]{2,8} [0-9]{1,2}, [0-9]{4}",
}
DAY_OR_MONTH_FIRST = {"M/d/yyyy": "d/M/yyyy", "d/M/yyyy": "M/d/yyyy", "M-d-yyyy": "d-M-yyyy", "d-M-yyyy": "M-d-yyyy"}
_TIME = r"( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?"
DATE_LIKE = r"^\s*([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2} [A-Z][a-z]{2,8} [0-9]{4}|[A-Z][a-z]{2,8} [0-9]{1,2}, [0-9]{4})"


def parse_date(v: Column, form: str) -> Column:
    """Moment of a text of one of ``DATE_FORMATS``, with or without hours; null for others."""
    shaped = v.rlike(rf"^\s*{DATE_FORMATS[form]}{_TIME}\s*$")
    return F.when(shaped, F.try_to_timestamp(F.trim(v), F.lit(form + "[ H:mm[:ss]]")).cast("timestamp_ntz"))


def type_tests(v: Column) -> dict[str, Column]:
    """Does a text parse as each class?  Order is the tie order of inference."""
    return {
        "Boolean": F.lower(v).isin(*BOOLEAN_WORDS),
        "Integer": v.rlike(INTEGER) & F.trim(v).try_cast("bigint").isNotNull(),
        "Decimal": v.rlike(DECIMAL) & v.rlike("[0-9]"),
        "DateTime": v.rlike(DATETIME) & F.try_to_timestamp(v).isNotNull(),
        "Guid": v.rlike(GUID),
        "Email": v.rlike(EMAIL),
        "Url": v.rlike(URL),
        "Json": (v.startswith("{") & v.endswith("}")) | (v.startswith("[") & v.endswith("]")),
    }
