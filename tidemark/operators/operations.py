"""Lineage graphs and analytics over operational log tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import tokens
from tidemark.session import materialize, spread


def lineage_nodes(entries: DataFrame) -> DataFrame:
    """Distinct source, target and transformation nodes of lineage entries
    (lineage_id, source_workspace, source_lakehouse, table_name, target_path, transformations)."""
    source = F.struct(_source_id().alias("id"), F.lit("Source").alias("type"), F.col("table_name").alias("name"))
    target = F.struct(F.col("target_path").alias("id"), F.lit("Target").alias("type"), F.element_at(F.split("target_path", "/"), -1).alias("name"))
    steps = F.transform("transformations", lambda s: F.struct(_step_id(s).alias("id"), F.lit("Transformation").alias("type"), s.alias("name")))
    return entries.select(F.inline(F.concat(F.array(source, target), steps))).groupBy("id").agg(F.min("type").alias("type"), F.min("name").alias("name"))


def lineage_edges(entries: DataFrame) -> DataFrame:
    """sync edges source -> target, transform edges into and output edges out of each step."""
    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("operation"))
    sync = F.array(edge(_source_id(), F.col("target_path"), "sync"))
    into = F.transform("transformations", lambda s: edge(_source_id(), _step_id(s), "transform"))
    out = F.transform("transformations", lambda s: edge(_step_id(s), F.col("target_path"), "output"))
    return entries.select("lineage_id", F.inline(F.concat(sync, into, out)))


def _source_id() -> Column:
    return F.concat_ws("/", "source_workspace", "source_lakehouse", "table_name")


def _step_id(step: Column) -> Column:
    return F.concat_ws("_", F.col("lineage_id").cast("string"), step)


def api_summary(calls: DataFrame) -> DataFrame:
    """Calls, successes (status below 400), failures and mean duration."""
    ok = F.count_if(F.col("status") < 400)
    return calls.agg(F.count(F.lit(1)).alias("calls"), ok.alias("ok"), (F.count(F.lit(1)) - ok).alias("failed"), F.avg("duration_ms").alias("mean_ms"))


def top_callers(calls: DataFrame, by: Column, k: int = 10) -> DataFrame:
    return calls.groupBy(by.alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(k)


def operation_profile(calls: DataFrame, operation: str, duration: str) -> DataFrame:
    d = F.col(duration)
    return calls.groupBy(operation).agg(F.count(d).alias("n"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.min(d).alias("lo"), F.max(d).alias("hi"))


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric rows (metric, value, ...) that meet a rule (rule, metric, op, threshold, severity)."""
    v, t = F.col("value"), F.col("threshold")
    hit = (F.when(F.col("op") == ">", v > t).when(F.col("op") == ">=", v >= t).when(F.col("op") == "<", v < t)
           .when(F.col("op") == "<=", v <= t).when(F.col("op") == "=", v == t))
    return metrics.join(rules, "metric").where(hit)


def sla_report(requests: DataFrame, service: str, duration: str, threshold: float) -> DataFrame:
    """Violations and uptime % per service over all requests."""
    bad = F.count_if(F.col(duration) > threshold)
    n = F.count(F.lit(1))
    return requests.groupBy(service).agg(n.alias("requests"), bad.alias("violations"), ((n - bad) / n * 100).alias("uptime_pct"))


# Anti-pattern expressions with severity.
_LINT = {
    "select_star": (r"(?i)SELECT\s+\*\s+FROM", "Medium"),
    "or_chain": (r"(?i)(\w+)\s*=\s*'[^']*'\s+OR\s+\1\s*=\s*'[^']*'", "Low"),
    "function_in_where": (r"(?i)WHERE\s+\w+\([^)]+\)\s*[=<>]", "High"),
    "comma_join": (r"(?i)FROM\s+\w+\s*,\s*\w+", "Medium"),
    "scalar_subquery": (r"(?i)SELECT[^,]*\([^)]*SELECT", "Medium"),
    "union_without_all": (r"(?i)\bUNION\s+(?!ALL)", "Low"),
}
WHERE, JOIN, DISTINCT = r"(?i)\bWHERE\b", r"(?i)\b(INNER|LEFT|RIGHT|FULL)\s+JOIN\b", r"(?i)\bDISTINCT\b"


def lint(queries: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per query and anti-pattern with its severity."""
    q = F.col(text)
    tests = {n: (q.rlike(p), s) for n, (p, s) in _LINT.items()}
    tests["missing_where"] = (~q.rlike(WHERE) & ~q.rlike(JOIN), "High")
    tests["repeated_distinct"] = (F.regexp_count(q, F.lit(DISTINCT)) > 1, "Medium")
    issues = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, (c, s) in tests.items()]))
    return spread(queries.select(ident, text)).select(ident, F.inline(issues))


def worst_severity(issues: DataFrame, ident: str) -> DataFrame:
    level = F.max(F.when(F.col("severity") == "High", 3).when(F.col("severity") == "Medium", 2).otherwise(1))
    return issues.groupBy(ident).agg(F.count(F.lit(1)).alias("issues"), F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), level).alias("overall"))


def search(df: DataFrame, doc: str, text: str, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best documents for a query by BM25.

    Texts are tokenised once; what is kept per document is its length and the
    query terms it holds, and only those are counted and shuffled."""
    terms = sorted(set(re.findall("[a-z]+", query.lower())))
    words = tokens(F.col(text))
    base = spread(df.select(doc, text)).select(doc, F.size(words).alias("_len"), F.filter(words, lambda w: w.isin(*terms)).alias("_hits"))
    base = materialize(base, "postings")
    n, avg_len = base.agg(F.count(F.lit(1)), F.avg("_len")).first()
    tf = base.select(doc, "_len", F.explode("_hits").alias("token")).groupBy(doc, "_len", "token").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select("token", F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.lit(avg_len)))
    # at most one idf row per query term
    scored = tf.join(F.broadcast(idf), "token").groupBy(doc).agg(F.sum(part).alias("score"))
    return scored.orderBy(F.desc("score"), doc).limit(k)


def process_json(df: DataFrame, ident: str, column: str, schema: str) -> DataFrame:
    """Parsed rows beside an ``error`` flag for texts that do not parse."""
    ok = F.try_parse_json(column).isNotNull()
    return df.select(ident, F.from_json(column, schema).alias("parsed"), (~ok).alias("error"))


class Plugins:
    """Named DataFrame transformations, registered once and applied by name."""

    def __init__(self):
        self._steps: dict[str, Callable[[DataFrame], DataFrame]] = {"identity": lambda df: df}

    def register(self, name: str, step: Callable[[DataFrame], DataFrame]) -> None:
        self._steps[name] = step

    def apply(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return reduce(lambda d, n: d.transform(self._steps[n]), names, df)
