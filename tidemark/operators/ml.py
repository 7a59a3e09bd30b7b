"""Model training, evaluation, clustering and recommendation on Spark ML."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import cosine_similarity
from tidemark.operators.ordered import running, top_per_group
from tidemark.operators.trees import BoostedTrees, Forest, TreeEstimator, fit_together
from tidemark.session import materialize

SEED = 42


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def classifiers(iterations: int = 100) -> dict[str, Estimator]:
    """Binary and multiclass trainers by name, with the usual defaults."""
    base = C.GBTClassifier(maxIter=iterations, maxDepth=5, minInstancesPerNode=10, stepSize=0.1, seed=SEED)
    return {
        "gbt": base,
        "fast_gbt": base.copy({base.stepSize: 0.2}),
        "logistic": C.LogisticRegression(maxIter=iterations, regParam=0.01),
        "max_entropy": C.LogisticRegression(maxIter=iterations, regParam=0.01, family="multinomial"),
        "max_entropy_l1": C.LogisticRegression(maxIter=iterations, regParam=0.01, elasticNetParam=0.5, family="multinomial"),
        "forest": C.RandomForestClassifier(numTrees=iterations, seed=SEED),
        "one_vs_rest_gbt": C.OneVsRest(classifier=base, parallelism=4),
    }


def regressors(iterations: int = 100) -> dict[str, Estimator]:
    base = BoostedTrees(maxIter=iterations, maxDepth=5, minInstancesPerNode=10, stepSize=0.1, seed=SEED)
    return {
        "gbt": base,
        "fast_gbt": base.copy({base.stepSize: 0.2}),
        "forest": Forest(numTrees=iterations, seed=SEED),
        "linear": R.LinearRegression(maxIter=iterations, regParam=0.01),
    }


def train(df: DataFrame, estimator: Estimator, label: str = "label") -> PipelineModel:
    """A fitted model without Spark ML's training summary.

    Predictions send the model to the executors, and the summary of a binary classifier
    holds the session, which cannot be sent once a query of it used an ``Observation``."""
    for param in ("labelCol",):
        if estimator.hasParam(param):
            estimator = estimator.copy({estimator.getParam(param): label})
    model = Pipeline(stages=[estimator]).fit(df)
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    return model


def train_together(df: DataFrame, estimators: Sequence[TreeEstimator], label: str = "label") -> list[PipelineModel]:
    """Models as ``train`` makes them, of rows that are binned once."""
    return [PipelineModel([m]) for m in fit_together(df, [e.copy({e.labelCol: label}) for e in estimators])]


def train_all(df: DataFrame, trainers: Mapping[str, Estimator], label: str = "label") -> dict[str, PipelineModel]:
    """All trainers fitted at the same time: each runs many short jobs, one after another."""
    alike = [n for n, e in trainers.items() if isinstance(e, TreeEstimator)]
    groups = ([alike] if alike else []) + [[n] for n in trainers if n not in alike]

    def fit(names: list[str]) -> list[PipelineModel]:
        if names is alike:
            return train_together(df, [trainers[n] for n in names], label)
        return [train(df, trainers[n], label) for n in names]

    with ThreadPool(max(len(groups), 1)) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(fit), groups, chunksize=1)
    models = {n: m for names, each in zip(groups, found, strict=True) for n, m in zip(names, each, strict=True)}
    return {n: models[n] for n in trainers}


# --- metrics from a prediction table -------------------------------------------------


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """accuracy, precision, recall, F1 and AUC.  Scores collapse to counts per value;
    AUC is the share of (positive, negative) pairs in the right order, ties half."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    per = df.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    cum = running(per, [], ["_s"], sums={"_below": F.col("neg")})
    s = {c: F.sum(c) for c in ("pos", "neg", "tp", "fp", "fn", "tn")}
    good = F.sum(F.col("pos") * (F.col("_below") - F.col("neg") * 0.5))
    precision, recall = F.try_divide(s["tp"], s["tp"] + s["fp"]), F.try_divide(s["tp"], s["tp"] + s["fn"])
    return cum.agg(
        F.try_divide(s["tp"] + s["tn"], s["pos"] + s["neg"]).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"), F.try_divide(good, s["pos"] * s["neg"]).alias("auc"))


def multiclass_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", probability: str = "p_true") -> DataFrame:
    """micro accuracy, macro accuracy (mean recall), log loss and its reduction against
    the class priors.  ``probability`` is the one given to the true class."""
    loss = -F.log(F.greatest(F.col(probability), F.lit(1e-15)))
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(prediction)).alias("ok"), F.sum(loss).alias("loss"))
    total = F.sum("n")
    log_loss = F.sum("loss") / total
    prior = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    return per.agg((F.sum("ok") / total).alias("micro_accuracy"), F.avg(F.col("ok") / F.col("n")).alias("macro_accuracy"),
                   log_loss.alias("log_loss"), (1 - F.try_divide(log_loss, prior)).alias("log_loss_reduction"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    mse = F.avg(e * e)
    return df.agg((1 - F.try_divide(mse, F.var_pop(label))).alias("r2"), F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def score_binary(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def score_multiclass(model: Model, df: DataFrame, label: str = "label") -> DataFrame:
    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn("p_true", F.get(vector_to_array("probability"), F.col(label).cast("int")))
    # one against the rest: each class has its own boosted trees with a margin
    each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(each, F.lit(0.0), lambda s, p: s + p)
    return out.withColumn("p_true", F.get(each, F.col(label).cast("int")) / total)


def compare(train_df: DataFrame, test_df: DataFrame | None, trainers: Mapping[str, Estimator], kind: str, label: str = "label", budget_seconds: float | None = None) -> tuple[DataFrame, dict[str, Model]]:
    """Fit each trainer and report its metrics, best first.  Without a test set the
    training set is scored.  ``budget_seconds`` stops starting new fits; trainers not
    tried are listed without metrics."""
    started, frames, skipped = time.time(), [], []
    models = train_all(train_df, trainers, label) if budget_seconds is None else {}
    for name, est in trainers.items():
        if budget_seconds is not None:
            if models and time.time() - started > budget_seconds:
                skipped.append(name)
                continue
            models[name] = train(train_df, est, label)
        data = test_df if test_df is not None else train_df
        if kind == "binary":
            m = binary_metrics(score_binary(models[name], data), label)
        elif kind == "multiclass":
            m = multiclass_metrics(score_multiclass(models[name], data, label), label)
        else:
            m = regression_metrics(models[name].transform(data), label)
        frames.append(m.select(F.lit(name).alias("trainer"), "*"))
    best = {"binary": "accuracy", "multiclass": "micro_accuracy", "regression": "r2"}[kind]
    frames += [train_df.sparkSession.range(1).select(F.lit(n).alias("trainer")) for n in skipped]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.orderBy(F.desc_nulls_last(best), "trainer"), models


def ensemble(df: DataFrame, models: Mapping[str, Model]) -> DataFrame:
    """Average prediction of several regressors, scored row by row without joins."""
    for n, m in models.items():
        df = m.transform(df).withColumnRenamed("prediction", f"_p_{n}")
    mean = reduce(lambda a, b: a + b, [F.col(f"_p_{n}") for n in models]) / len(models)
    return df.withColumn("prediction", mean).drop(*[f"_p_{n}" for n in models])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- clustering ----------------------------------------------------------------------


def kmeans(df: DataFrame, k: int = 3, features: str = "features") -> tuple[Model, DataFrame]:
    model = KMeans(k=k, seed=SEED, featuresCol=features).fit(df)
    return model, model.transform(df)


def cluster_quality(model: Model, clustered: DataFrame, features: str = "features") -> DataFrame:
    """Size and mean distance per cluster, overall mean distance and Davies-Bouldin index."""
    centers = [c.tolist() for c in model.clusterCenters()]
    mine = F.array(*[F.array(*map(F.lit, c)) for c in centers])[F.col("prediction")]
    diff = F.zip_with(vector_to_array(features), mine, lambda a, b: (a - b) * (a - b))
    dist = F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v))
    per = clustered.select("prediction", dist.alias("d")).groupBy("prediction").agg(F.count(F.lit(1)).alias("size"), F.avg("d").alias("avg_distance"))
    rows = {r.prediction: r for r in per.collect()}  # k rows
    total = sum(r["size"] for r in rows.values())
    mean = sum(r["size"] * r.avg_distance for r in rows.values()) / total if total else 0.0
    worst = [max(((rows[i].avg_distance + rows[j].avg_distance) / (math.dist(centers[i], centers[j]) or 1e-12) for j in rows if j != i), default=0.0) for i in rows]
    return per.withColumns({"overall_distance": F.lit(float(mean)), "davies_bouldin": F.lit(float(sum(worst) / max(len(worst), 1)))})


def choose_k(df: DataFrame, low: int = 2, high: int = 10, features: str = "features") -> DataFrame:
    """Mean distance per k; the chosen k has the largest drop against k - 1."""
    means = []
    for k in range(low, high + 1):
        model, out = kmeans(df, k, features)
        means.append((k, cluster_quality(model, out, features).first().overall_distance))
    every = {k: a - b for (_, a), (k, b) in zip(means, means[1:])}
    # the last k has no drop after it; a short range has no other
    drops = {k: d for k, d in every.items() if k < high} or every
    best = max(drops, key=lambda k: (drops[k], -k), default=low)
    return df.sparkSession.createDataFrame([(k, d, drops.get(k), k == best) for k, d in means], "k int, avg_distance double, drop double, chosen boolean")


def cluster_profile(df: DataFrame, cluster: str, features: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"avg_{n}") for n, c in features.items()])


# --- recommendation ------------------------------------------------------------------


LEAST_BLOCKS, BLOCK_RATINGS = 10, 2_000_000  # of a factorisation: Spark's own number of blocks, and ratings of a block beyond it


def factorize(df: DataFrame, user: str, item: str, rating: str, rank: int = 8, iterations: int = 20) -> Model:
    """Alternating least squares.  ``df`` is counted first: a task holds all ratings of a block
    of users or items and the factors they meet, so blocks are as many as the ratings need.
    The factors to start from are drawn block by block, so they depend on that number.  More blocks
    send a factor to more of them, so shuffles are freed (by checkpoints, if ``spark.checkpoint.dir``
    is set) after three iterations then, not after Spark's ten."""
    blocks = max(LEAST_BLOCKS, math.ceil(df.count() / BLOCK_RATINGS))
    als = ALS(rank=rank, maxIter=iterations, regParam=0.01, userCol=user, itemCol=item, ratingCol=rating, seed=SEED, coldStartStrategy="drop",
              numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=10 if blocks == LEAST_BLOCKS else 3)
    return als.fit(df)


ITEM_CHUNK, USER_BLOCK = 65_536, 131_072  # rows of a group of items, and of users at most
_ROUNDED = 1e-5  # relative error allowed to sums of a few products of floats


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    """A matrix of an array column whose rows have equal lengths."""
    return column.combine_chunks().flatten().to_numpy().astype(np.float32).reshape(len(column), -1)


def _best_items(items: pa.Table, users: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of user, item, score) of the n best items of each user that reach its floor.

    Items come by falling length; a user is done once its length times theirs is less
    than its n-th score."""
    order = np.argsort(-items["norm"].to_numpy(), kind="stable")
    ids, norms, v = items["id"].to_numpy()[order], items["norm"].to_numpy()[order], _floats(items["features"])[order]
    u, own, floor = _floats(users["features"]), users["norm"].to_numpy(), users["floor"].to_numpy()
    scores, found = np.full((own.size, n), -np.inf, np.float32), np.zeros((own.size, n), ids.dtype)
    for a in range(0, own.size, 1024):
        live, least = np.arange(a, min(a + 1024, own.size)), floor[a : a + 1024].copy()
        for i in range(0, ids.size, 4096):
            reach = own[live] * norms[i] * (1 + _ROUNDED) >= least[live - a]
            live = live[reach]
            if not live.size:
                break
            s = u[live] @ v[i : i + 4096].T
            hit = np.flatnonzero(s.max(1) >= least[live - a])
            rows = live[hit]
            every = np.concatenate([scores[rows], s[hit]], 1)
            names = np.concatenate([found[rows], np.broadcast_to(ids[i : i + 4096], (hit.size, s.shape[1]))], 1)
            best = np.argpartition(-every, n - 1, 1)[:, :n]
            scores[rows], found[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)
            least[rows - a] = np.maximum(least[rows - a], scores[rows].min(1))
    at, k = np.nonzero((scores > -np.inf) & (scores >= floor[:, None]))
    return at, found[at, k], scores[at, k]


def recommend(model: Model, users: DataFrame, n: int) -> DataFrame:
    """Top-N items for each user of a one-column frame; seen items are not excluded.

    A score is at most the product of the lengths of both factors.  So all users meet
    the longest items first, and then only those groups of items whose length can
    reach a user's n-th score so far: exact, and each group is bounded in size."""
    spark, user, item = users.sparkSession, model.getUserCol(), model.getItemCol()
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    items = materialize(running(model.itemFactors.select("id", "features", norm.alias("norm")), [], [F.desc("norm"), "id"], position="_at"), "items")
    items = items.withColumn("chunk", F.floor((F.col("_at") - 1) / ITEM_CHUNK).cast("int")).drop("_at")
    own = model.userFactors.join(users.select(F.col(user).alias("id")).distinct(), "id")
    own = materialize(own.select("id", "features", norm.alias("norm"), F.lit(float("-inf")).alias("floor")), "users")
    longest = {r["chunk"]: r["norm"] for r in items.groupBy("chunk").agg(F.max("norm").alias("norm")).collect()}  # one row per ITEM_CHUNK items
    blocks = max(math.ceil(own.count() / USER_BLOCK), 2 * spark.sparkContext.defaultParallelism)
    kind = items.schema["id"].dataType.simpleString()

    def search(chunk: pa.Table, block: pa.Table) -> pa.Table:
        at, ids, scores = _best_items(chunk, block, n) if chunk.num_rows and block.num_rows else (np.zeros(0, int),) * 3
        names = block["id"].to_numpy()[at] if at.size else at
        return pa.table({user: pa.array(names, pa.int32()), item: pa.array(ids, pa.int32()), "rating": pa.array(scores, pa.float32())})

    def met(asked: DataFrame, chunks: DataFrame) -> DataFrame:
        asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        chunks = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return chunks.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(search, f"`{user}` {kind}, `{item}` {kind}, rating float")

    first = materialize(met(own.withColumn("chunk", F.lit(0)), items.where("chunk = 0")), "first")
    if len(longest) < 2:
        return first
    floors = first.groupBy(F.col(user).alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min("rating").cast("double").alias("_least")).where(F.col("_n") == n)
    asked = own.drop("floor").join(floors, "id", "left").withColumn("floor", F.coalesce(F.col("_least") - F.abs("_least") * _ROUNDED, F.lit(float("-inf"))))
    rest = F.array(*[F.struct(F.lit(c).alias("chunk"), F.lit(m).alias("most")) for c, m in sorted(longest.items()) if c])
    asked = asked.select("id", "features", "norm", "floor", F.inline(rest)).where(F.col("norm") * F.col("most") * (1 + _ROUNDED) >= F.col("floor")).drop("most")
    more = met(materialize(asked, "asked"), items.where("chunk > 0"))
    return top_per_group(first.unionByName(more), [user], [F.desc("rating"), item], n)


def similar_items(df: DataFrame, ident: str, vector: str, targets: Sequence, n: int) -> DataFrame:
    """Top-N items by cosine for each of a few target ids, the target itself excluded.

    The caller names the targets, so their vectors are few and enter the plan as
    literals: one map-only scan scores every item."""
    found = df.where(F.col(ident).isin(*targets)).select(ident, vector).collect()  # at most len(targets) rows
    if not found:
        raise ValueError("no such target")
    wanted = F.array(*[F.struct(F.lit(r[0]).alias("target"), F.array(*[F.lit(float(x)) for x in r[1]]).alias("_tv")) for r in found])
    pairs = df.select("*", F.inline(wanted)).where(F.col(ident) != F.col("target"))
    scored = pairs.select("target", ident, cosine_similarity(F.col("_tv"), F.col(vector)).alias("similarity"))
    return top_per_group(scored, ["target"], [F.desc("similarity"), F.col(ident)], n)


def vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


# --- experiments ---------------------------------------------------------------------


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Latest value per run and metric name by step."""
    return metrics.groupBy("run_id", "name").agg(F.max_by("value", "step").alias("value"))


def best_run(metrics: DataFrame, name: str, higher_is_better: bool = True) -> DataFrame:
    order = F.desc("value") if higher_is_better else F.asc("value")
    return latest_metrics(metrics.where(F.col("name") == name)).orderBy(order, "run_id").limit(1)
