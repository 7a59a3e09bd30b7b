"""Feature engineering as Column expressions over one-row statistics.

Statistics are a single aggregate row; they enter the plan as literals, so
scoring is a map-only projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import modes, quantiles
from tidemark.operators.reshape import pivot_values
from tidemark.session import materialize, spread


def scale(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """``minmax``, ``meanvar`` or ``logmeanvar`` into ``{c}_scaled``."""
    x = {c: F.ln(F.when(F.col(c) > 0, F.col(c))) if how == "logmeanvar" else F.col(c).cast("double") for c in columns}
    stats = df.agg(*[f(x[c]).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("sd", F.stddev_pop))]).first()

    def scaled(c: str) -> Column:
        shift, width = (stats[f"lo_{c}"], (stats[f"hi_{c}"] or 0) - (stats[f"lo_{c}"] or 0)) if how == "minmax" else (stats[f"mean_{c}"], stats[f"sd_{c}"])
        return (x[c] - F.lit(shift)) / F.lit(width) if width else F.when(x[c].isNotNull(), F.lit(0.0))

    return df.withColumns({f"{c}_scaled": scaled(c) for c in columns})


def one_hot(df: DataFrame, column: str, labels: Sequence[str] | None = None) -> DataFrame:
    """0/1 columns ``{column}_{label}``; the label list is bounded like a pivot's."""
    labels = labels or pivot_values(df, column)
    return df.withColumns({f"{column}_{v}": (F.coalesce(F.col(column).cast("string"), F.lit("NULL")) == v).cast("int") for v in labels})


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not anew for each element it is compared with."""
    return F.get(F.transform(F.array(value), body), 0)


def _text_counts(words: Column) -> Column:
    """(token, tf) structs of the distinct words of one text."""

    def firsts(ordered: Column) -> Column:
        places = F.transform(ordered, lambda w, i: F.struct(w.alias("token"), i.cast("long").alias("i")))
        return F.filter(places, lambda r, i: (i == 0) | (r["token"] != F.get(ordered, i - 1)))

    def lengths(first: Column, n: Column) -> Column:
        return F.transform(first, lambda r, i: F.struct(r["token"].alias("token"), (F.coalesce(F.get(first, i + 1)["i"], n) - r["i"]).alias("tf")))

    return _bound(F.sort_array(words), lambda w: _bound(firsts(w), lambda f: lengths(f, F.size(w).cast("long"))))


def term_counts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Occurrences per (document, token).  A text is counted within its row; only
    documents that have several rows are added up by a shuffle."""
    rows = spread(df.select(doc, text))
    counts = rows.select(doc, F.inline(_text_counts(tokens(F.col(text)))))
    several = materialize(df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(doc).alias("_doc")), "several")
    if several.isEmpty():
        return counts
    same = F.col(doc).eqNullSafe(F.col("_doc"))
    added = counts.join(several, same, "left_semi").groupBy(doc, "token").agg(F.sum("tf").alias("tf"))
    return counts.join(several, same, "left_anti").unionByName(added)


def tf_idf(df: DataFrame, doc: str, text: str) -> DataFrame:
    """tf * ln((N + 1) / (df + 1)) per document and token.

    The documents per token are stored, so that their size is known when the join is
    planned: a small vocabulary is sent to the counts, which then are not shuffled."""
    n = df.count()
    counts = term_counts(df, doc, text)
    in_docs = materialize(counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    return counts.join(in_docs, "token").select(doc, "token", "tf", (F.col("tf") * F.ln((F.lit(n) + 1) / (F.col("df") + 1))).alias("tf_idf"))


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """All products of up to ``degree`` columns, e.g. ``a*b`` and ``a*a``."""
    new = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            expr = F.col(combo[0]).cast("double")
            for c in combo[1:]:
                expr = expr * F.col(c)
            new["*".join(combo)] = expr
    return df.withColumns(new)


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{a}*{b}": F.col(a).cast("double") * F.col(b) for a, b in combinations(columns, 2)})


def bins(df: DataFrame, column: str, count: int = 10) -> DataFrame:
    """Quantile bins 0..count-1; equal cuts collapse."""
    one = df.select(F.col(column).cast("double").alias("_x"))
    cuts = quantiles(one, [], "_x", [i / count for i in range(1, count)]).first()
    edges = sorted({c for c in (cuts or ()) if c is not None})
    index = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), index))


def impute(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Fill nulls by the column's mean, median or mode (lowest on ties)."""
    new = {}
    for c in columns:
        one = df.select(F.col(c).alias("_x"))
        if how == "mean":
            row = one.agg(F.avg("_x")).first()[0]
        elif how == "median":
            row = (quantiles(one, [], "_x", [0.5]).select("q0").first() or [None])[0]
        elif how == "mode":
            row = (modes(one, [], "_x", "m").select("m").first() or [None])[0]
        else:
            raise ValueError(f"unknown imputation {how}")
        new[c] = F.coalesce(F.col(c), F.lit(row))
    return df.withColumns(new)
