"""Model selection: successive halving over a parameter grid on folds dealt by hash."""

from __future__ import annotations

import itertools
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ml
from tidemark.operators.trees import TreeEstimator

BEST = {"binary": "accuracy", "multiclass": "micro_accuracy", "regression": "r2"}


def deal(df: DataFrame, key: str | Sequence[str], folds: int, name: str = "fold") -> DataFrame:
    """``df`` with the fold of each row, from 0: the first 32 bits of the key's MD5 modulo ``folds``.

    A row's fold depends on its key alone, not on partitions or other rows.  Null
    keys count as empty texts; rows of one key share a fold, so none of them is
    trained on while another is held out."""
    keys = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.withColumn(name, (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % folds).cast("int"))


@dataclass(frozen=True)
class Candidate:
    trainer: str
    params: tuple[tuple[str, float | int | str], ...]
    estimator: Estimator

    @property
    def shown(self) -> str:
        return ", ".join(f"{k}={v}" for k, v in self.params)


def grid(trainers: Mapping[str, Estimator], choices: Mapping[str, Mapping[str, Sequence]]) -> list[Candidate]:
    """Every trainer with every combination of its parameter values, in the order given."""
    out = []
    for name, est in trainers.items():
        own = choices.get(name, {})
        for values in itertools.product(*own.values()):
            params = tuple(zip(own, values, strict=True))
            out.append(Candidate(name, params, est.copy({est.getParam(k): v for k, v in params})))
    return out


def measured(model: Model, df: DataFrame, kind: str, label: str = "label") -> dict[str, float]:
    """Metrics of a model's predictions, one row that Spark aggregates."""
    if kind == "binary":
        m = ml.binary_metrics(ml.score_binary(model, df), label)
    elif kind == "multiclass":
        m = ml.multiclass_metrics(ml.score_multiclass(model, df, label), label)
    else:
        m = ml.regression_metrics(model.transform(df), label)
    return m.first().asDict()


def halving(
    dealt: DataFrame, candidates: Sequence[Candidate], kind: str, rungs: Sequence[int] = (2, 4, 8), validation: int = 8, test: int = 9,
    keep: float = 0.5, label: str = "label", parallelism: int = 4, budget_seconds: float | None = None,
) -> tuple[DataFrame, Model]:
    """Report of all candidates, best first, and the winner's model.

    ``dealt`` is a stored table with a column ``fold``.  Rung r trains every candidate
    left on folds 0 to rungs[r] - 1 and measures it on fold ``validation``; the better
    share ``keep`` goes on, the others are dropped.  The last rung's best has won; its
    model is measured once more on fold ``test``, which no choice has seen.

    The report has a row per candidate (scope ``validation``: metrics of its last rung,
    rung, status ``won``, ``dropped`` or ``not reached``, and the rows it was trained
    and measured on) and the winner's row of scope ``test``.  Equal metrics go by the
    order of the candidates.  Trees of a rung are fitted together, unless the clock may
    end it between them.  Nothing is decided by the clock unless ``budget_seconds``
    is given: candidates that are not begun by then in the first rung are ``not
    reached``, later rungs end with what is measured."""
    spark, better, started = dealt.sparkSession, BEST[kind], time.monotonic()
    sizes = {r["fold"]: r["n"] for r in dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per fold
    held, last = dealt.where(F.col("fold") == validation), {}
    left, models = list(range(len(candidates))), {}

    def fitted(own: list[int], folds: int) -> list[tuple[int, Model]]:
        if budget_seconds is not None and time.monotonic() - started > budget_seconds:
            return []
        rows, estimators = dealt.where(F.col("fold") < folds), [candidates[i].estimator for i in own]
        if len(own) > 1:
            return list(zip(own, ml.train_together(rows, estimators, label), strict=True))
        return [(own[0], ml.train(rows, estimators[0], label))]

    def rank(i: int) -> tuple:
        value = last[i][1].get(better)
        return (value is None or value != value, -(value or 0.0), i)

    for r, folds in enumerate(rungs):
        alike = [i for i in left if budget_seconds is None and isinstance(candidates[i].estimator, TreeEstimator)]
        groups = ([alike] if alike else []) + [[i] for i in left if i not in alike]
        with ThreadPool(max(1, min(parallelism, len(left)))) as pool:
            new = [x for own in pool.map(inheritable_thread_target(spark)(lambda own, n=folds: fitted(own, n)), groups, chunksize=1) for x in own]
            found = pool.map(inheritable_thread_target(spark)(lambda x: (*x, measured(x[1], held, kind, label))), new, chunksize=1)
        for i, model, metrics in found:
            models[i], last[i] = model, (r, metrics)
        done = sorted((i for i, *_ in found), key=rank)
        if len(done) < len(left) and r:
            break  # the clock ended a later rung
        left = done if r == len(rungs) - 1 else done[: max(1, int(len(done) * keep))]
    reached = max((r for r, _ in last.values()), default=-1)
    if reached < 0:
        raise ValueError("no candidate was reached")
    won = min((i for i in last if last[i][0] == reached), key=rank)
    tested = measured(models[won], dealt.where(F.col("fold") == test), kind, label)
    names = list(tested)
    row = lambda i, scope, rung, status, rows, metrics: (candidates[i].trainer, candidates[i].shown, scope, rung, status, *rows, *(metrics.get(n) for n in names))
    rows = []
    for i in sorted(last, key=lambda i: (i != won, -last[i][0], rank(i))):
        r, metrics = last[i]
        used = (sum(sizes.get(f, 0) for f in range(rungs[r])), sizes.get(validation, 0))
        rows.append(row(i, "validation", r, "won" if i == won else "dropped", used, metrics))
        if i == won:
            rows.append(row(i, "test", r, "won", (used[0], sizes.get(test, 0)), tested))
    rows += [row(i, "validation", None, "not reached", (None, None), {}) for i in range(len(candidates)) if i not in last]
    schema = "trainer string, params string, scope string, rung int, status string, train_rows long, measured_rows long, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema), models[won]
