"""Column selection and predicates built as Columns, never as concatenated SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wildcard_regex(pattern: str) -> str:
    """``*`` matches any run and ``?`` one character; all else is literal."""
    return "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def wildcard_match(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + wildcard_regex(pattern))


def select_columns(df: DataFrame, mode: str, columns: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """``include`` / ``exclude`` / ``pattern`` / ``all``, case-insensitive, in source order."""
    named = {c.lower() for c in columns}
    if mode == "include":
        keep = [c for c in df.columns if c.lower() in named]
    elif mode == "exclude":
        keep = [c for c in df.columns if c.lower() not in named]
    elif mode == "pattern":
        rules = [re.compile(wildcard_regex(p), re.IGNORECASE) for p in patterns]
        keep = [c for c in df.columns if any(r.match(c) for r in rules)]
    else:
        keep = df.columns
    return df.select(*keep)


def select_aliased(df: DataFrame, alias: str, columns: Sequence[str] = ()) -> DataFrame:
    """Projection through a table alias; no columns means all of them."""
    return df.alias(alias).select(*[F.col(f"{alias}.{c}") for c in (columns or df.columns)])


_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "in": lambda c, v: c.isin(*v),
    "between": lambda c, v: c.between(v[0], v[1]),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


def predicate(spec) -> Column:
    """``(column, op, value)`` or ``{"and"|"or": [spec, ...]}``, nested freely."""
    if isinstance(spec, Mapping):
        (op, parts), = spec.items()
        join = (lambda a, b: a & b) if op == "and" else (lambda a, b: a | b)
        return reduce(join, [predicate(p) for p in parts])
    column, op, *value = spec
    return _COMPARE[op](F.col(column), value[0] if value else None)


def column_security(
    df: DataFrame,
    roles: Sequence[str],
    policies: Mapping[str, Sequence[str]],
    masks: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Drop columns whose policy shares no role with the user; mask those asked for."""
    masks, have = masks or {}, set(roles)
    visible = [c for c in df.columns if c not in policies or have & set(policies[c])]
    return df.select(*[masks[c](F.col(c)).alias(c) if c in masks else F.col(c) for c in visible])


def apply_transforms(df: DataFrame, steps: Sequence[tuple[str, Callable[[Column], Column]]]) -> tuple[DataFrame, int]:
    """Ordered column transforms; a step on an absent column is skipped.  Returns the count applied."""
    present = [(c, f) for c, f in steps if c in df.columns]
    return reduce(lambda d, s: d.withColumn(s[0], s[1](F.col(s[0]))), present, df), len(present)


def time_range(df: DataFrame, ts: str, start, stop, *, inclusive: bool = False, **equals) -> DataFrame:
    """Half-open time range (closed when ``inclusive``) plus optional equality filters."""
    upper = F.col(ts) <= F.lit(stop) if inclusive else F.col(ts) < F.lit(stop)
    cond = (F.col(ts) >= F.lit(start)) & upper
    for c, v in equals.items():
        if v is not None:
            cond = cond & (F.col(c) == v)
    return df.where(cond)
