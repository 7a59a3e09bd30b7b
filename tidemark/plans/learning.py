"""Feature engineering and machine-learning queries."""

from pyspark.sql import functions as F

from tidemark.operators import automl
from tidemark.operators import features as ft
from tidemark.operators import ml
from tidemark.operators.ordered import running
from tidemark.plans.registry import query
from tidemark.session import Tables, materialize, scratch_path

ROUNDS = 100  # boosting rounds, trees and iterations in the registered queries
FOLDS = 10  # folds 0 to 7 train, 8 chooses, 9 is held out to the end
_FOLD = "('0x' || substr(md5({}), 1, 8))::UBIGINT % 10"


def _held_out(data):
    """(training rows, held-out rows) of a stored table with folds."""
    return data.where("fold < 8"), data.where("fold >= 8")


def _documents(t: Tables):
    """Label quality with whole-text features, stored once because training iterates over them."""
    text = F.col("text")
    words = F.split(text, r"\s+")
    d = t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), F.length(text).cast("double").alias("chars"), F.size(words).cast("double").alias("words"),
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / F.length(text)).alias("digit_share"), (F.length(F.regexp_replace(text, r"[\p{L}\s]", "")) / F.length(text)).alias("odd_share"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("variety"))
    return materialize(automl.deal(ml.assemble(d, ["chars", "words", "digit_share", "odd_share", "variety"]), "doc_id", FOLDS), "document-features")


def _lines(t: Tables):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", F.col("l_extendedprice").alias("label"), "l_quantity", "l_discount", "l_tax", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    # lines of one order share a fold
    return materialize(automl.deal(ml.assemble(d, ["l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size"]), "l_orderkey", FOLDS), "line-features")


def _vectors(t: Tables):
    return materialize(automl.deal(ml.vectors(t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), "embedding"), "embedding"), "vec_id", FOLDS), "vectors")


@query("compare_binary_classifiers", "M1 M2 M4")
def compare_binary_classifiers(t: Tables):
    c = ml.classifiers(ROUNDS)
    return ml.compare(*_held_out(_documents(t)), {k: c[k] for k in ("gbt", "fast_gbt", "logistic")}, "binary")[0]


@query("compare_multiclass_classifiers", "M3 M4")
def compare_multiclass_classifiers(t: Tables):
    c = ml.classifiers(ROUNDS)
    return ml.compare(*_held_out(_vectors(t)), {k: c[k] for k in ("max_entropy", "max_entropy_l1", "forest", "one_vs_rest_gbt")}, "multiclass")[0]


@query("compare_regressors", "M5 M6")
def compare_regressors(t: Tables):
    r = ml.regressors(ROUNDS)
    return ml.compare(*_held_out(_lines(t)), {k: r[k] for k in ("gbt", "fast_gbt", "forest", "linear")}, "regression")[0]


@query("regression_ensemble", "M6")
def regression_ensemble(t: Tables):
    r, (data, held) = ml.regressors(ROUNDS), _held_out(_lines(t))
    models = ml.train_all(data, {k: r[k] for k in ("gbt", "forest", "linear")})
    return ml.regression_metrics(ml.ensemble(held, models))


_TREES = {"numTrees": (20, 60), "maxDepth": (4, 8)}
_BOOSTED = {"maxIter": (20, 60), "stepSize": (0.1, 0.3)}
_LINEAR = {"regParam": (0.001, 0.01, 0.1), "elasticNetParam": (0.0, 0.5)}


def _automl(data, trainers, choices, kind):
    return automl.halving(data, automl.grid({k: trainers[k] for k in choices}, choices), kind)[0]


@query("automl_binary", "M7")
def automl_binary(t: Tables):
    return _automl(_documents(t), ml.classifiers(ROUNDS), {"logistic": _LINEAR, "forest": _TREES, "gbt": _BOOSTED}, "binary")


@query("automl_multiclass", "M7")
def automl_multiclass(t: Tables):
    return _automl(_vectors(t), ml.classifiers(ROUNDS), {"max_entropy": _LINEAR, "forest": _TREES}, "multiclass")


@query("automl_regression", "M7")
def automl_regression(t: Tables):
    return _automl(_lines(t), ml.regressors(ROUNDS), {"linear": _LINEAR, "forest": _TREES, "gbt": _BOOSTED}, "regression")


@query("automl_folds", "M7", f"""
SELECT 'documents' AS data, {_FOLD.format("doc_id::VARCHAR")} AS fold, count(*) AS rows, sum(quality)::DOUBLE AS label_sum FROM documents JOIN labels USING (doc_id) GROUP BY ALL
UNION ALL SELECT 'embeddings', {_FOLD.format("vec_id::VARCHAR")}, count(*), sum(label)::DOUBLE FROM embeddings GROUP BY ALL
UNION ALL SELECT 'lineitem', {_FOLD.format("l_orderkey::VARCHAR")}, count(*), round(sum(l_extendedprice), 2) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""", wide=True)
def automl_folds(t: Tables):
    """What each fold of the model queries holds."""
    per = [d.groupBy(F.lit(name).alias("data"), "fold").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("label"), 2).alias("label_sum"))
           for name, d in (("documents", _documents(t)), ("embeddings", _vectors(t)), ("lineitem", _lines(t)))]
    return per[0].unionByName(per[1]).unionByName(per[2])


@query("model_round_trip", "M8")
def model_round_trip(t: Tables):
    (data, held), path = _held_out(_documents(t)), scratch_path(t.spark, "model")
    ml.save_model(ml.train(data, ml.classifiers(ROUNDS)["logistic"]), path)
    return ml.binary_metrics(ml.score_binary(ml.load_model(path), held))


_PRED = "SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, (props->>'$.k')::DOUBLE / 100 AS s, CASE WHEN (props->>'$.k')::DOUBLE >= 50 THEN 1 ELSE 0 END AS p FROM events"


def _predictions(t: Tables):
    k = F.get_json_object("props", "$.k").cast("double")
    return t.events.select((F.col("event_type") == "purchase").cast("int").alias("label"), (k / 100).alias("score"), (k >= 50).cast("int").alias("prediction"))


@query("binary_metrics", "M9", f"""
WITH e AS ({_PRED}), c AS (SELECT count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn FROM e),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM e)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
 round(((SELECT sum(rk) FROM r WHERE y = 1) - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)), 6) AS auc FROM c""")
def binary_metrics(t: Tables):
    d = ml.binary_metrics(_predictions(t))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query("multiclass_metrics", "M9", """
WITH e AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS p, 0.2 + l_discount * 5 AS q FROM lineitem),
g AS (SELECT y, count(*)::DOUBLE AS n, count(*) FILTER (y = p) AS ok, sum(-ln(q)) AS loss FROM e GROUP BY 1),
a AS (SELECT sum(ok) / sum(n) AS mi, avg(ok / n) AS ma, sum(loss) / sum(n) AS ll, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS pr FROM g)
SELECT round(mi, 6) AS micro_accuracy, round(ma, 6) AS macro_accuracy, round(ll, 6) AS log_loss, round(1 - ll / pr, 6) AS log_loss_reduction FROM a""")
def multiclass_metrics(t: Tables):
    p = F.when(F.col("l_quantity") > 30, "A").when(F.col("l_linestatus") == "O", "N").otherwise("R")
    d = ml.multiclass_metrics(t.lineitem.select(F.col("l_returnflag").alias("label"), p.alias("prediction"), (0.2 + F.col("l_discount") * 5).alias("p_true")))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query("regression_metrics", "M9", """
WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)), 0) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM e""")
def regression_metrics(t: Tables):
    d = ml.regression_metrics(t.lineitem.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")))
    return d.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("mse", 0).alias("mse"), F.round("rmse", 4).alias("rmse"))


@query("kmeans_clusters", "M10")
def kmeans_clusters(t: Tables):
    model, out = ml.kmeans(_vectors(t), 3)
    return ml.cluster_quality(model, out)


@query("kmeans_choose_k", "M11")
def kmeans_choose_k(t: Tables):
    return ml.choose_k(_vectors(t), 2, 10)


@query("cluster_profile", "M12", "SELECT label, count(*) AS size, " + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 6) AS avg_d{i}" for i in range(64)) + " FROM embeddings GROUP BY 1")
def cluster_profile(t: Tables):
    d = ml.cluster_profile(t.embeddings, "label", {f"d{i}": F.col("embedding")[i].cast("double") for i in range(64)})
    return d.select("label", "size", *[F.round(f"avg_d{i}", 6).alias(f"avg_d{i}") for i in range(64)])


def _ratings(t: Tables):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_key"), F.col("l_partkey").alias("item_key"))
    d = materialize(d.agg(F.avg("l_quantity").cast("float").alias("rating")), "ratings")
    # the factorisation takes 32-bit ids: number both sides densely
    for side in ("user", "item"):
        numbers = running(materialize(d.select(f"{side}_key").distinct(), side), [], [f"{side}_key"], position=side)
        d = d.join(numbers.withColumn(side, F.col(side).cast("int")), f"{side}_key")
    return materialize(d, "ratings")


@query("factorization_metrics", "M13")
def factorization_metrics(t: Tables):
    data = _ratings(t)
    model = ml.factorize(data, "user", "item", "rating")
    return ml.regression_metrics(model.transform(data), "rating")


@query("recommend_items", "M14 O4")
def recommend_items(t: Tables):
    data = _ratings(t)
    found = ml.recommend(ml.factorize(data, "user", "item", "rating"), data.select("user").distinct(), 5)
    keys = [data.select(f"{side}_key", side).distinct() for side in ("user", "item")]
    return found.join(keys[0], "user").join(keys[1], "item").select(F.col("user_key").alias("user"), F.col("item_key").alias("item"), "rating")


@query("similar_items", "M15 X11", """
SELECT t.vec_id AS target, e.vec_id, round(list_cosine_similarity(t.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM embeddings t JOIN embeddings e ON t.vec_id <> e.vec_id WHERE t.vec_id IN (3, 17)
QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_cosine_similarity(t.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) <= 10""", wide=True)
def similar_items(t: Tables):
    return ml.similar_items(t.embeddings, "vec_id", "embedding", [3, 17], 10).withColumn("similarity", F.round("similarity", 6))


_S = "(SELECT *, ln(nullif(greatest(c_acctbal, 0), 0)) AS lg FROM customer)"


@query("feature_scaling", "M16", f"""
SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS minmax, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS meanvar,
 round((lg - avg(lg) OVER ()) / stddev_pop(lg) OVER (), 6) AS logmeanvar FROM {_S}""")
def feature_scaling(t: Tables):
    d = t.customer.select("c_custkey", "c_acctbal")
    for how in ("minmax", "meanvar", "logmeanvar"):
        d = ft.scale(d, ["c_acctbal"], how).withColumn(how, F.round("c_acctbal_scaled", 6)).drop("c_acctbal_scaled")
    return d.drop("c_acctbal")


@query("one_hot", "M17", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INTEGER AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(t: Tables):
    return ft.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("text_tf_idf", "M18", """
WITH c AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM c GROUP BY 1)
SELECT doc_id, token, tf, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE), 4) AS tf_idf FROM c JOIN d USING (token)""")
def text_tf_idf(t: Tables):
    return ft.tf_idf(t.documents, "doc_id", "text").withColumn("tf_idf", F.round("tf_idf", 4))


@query("polynomial_features", "M20", 'SELECT p_partkey, p_size::DOUBLE * p_size AS "p_size*p_size", p_size::DOUBLE * p_retailprice AS "p_size*p_retailprice", p_retailprice * p_retailprice AS "p_retailprice*p_retailprice" FROM part')
def polynomial_features(t: Tables):
    return ft.polynomial(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]).drop("p_size", "p_retailprice")


@query("quantile_bins", "M21", "WITH q AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM orders) SELECT o_orderkey, len(list_filter(c, lambda x: o_totalprice > x)) AS o_totalprice_bin FROM orders, q", wide=True)
def quantile_bins(t: Tables):
    return ft.bins(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice")


@query("feature_interactions", "M22", 'SELECT p_partkey, p_size::DOUBLE * p_retailprice AS "p_size*p_retailprice", p_size::DOUBLE * p_partkey AS "p_size*p_partkey", p_retailprice * p_partkey AS "p_retailprice*p_partkey" FROM part')
def feature_interactions(t: Tables):
    return ft.interactions(t.part.select("p_size", "p_retailprice", "p_partkey"), ["p_size", "p_retailprice", "p_partkey"]).drop("p_size", "p_retailprice")


_GAPS = "(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_discount < 0.08 THEN l_quantity END AS q FROM lineitem)"


@query("impute_values", "M23", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(coalesce(q, (SELECT avg(q) FROM {_GAPS})), 6) AS mean_q, coalesce(q, (SELECT median(q) FROM {_GAPS})) AS median_q,
 coalesce(q, (SELECT q FROM {_GAPS} WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)) AS mode_q FROM {_GAPS}""")
def impute_values(t: Tables):
    q = F.when(F.col("l_discount") < 0.08, F.col("l_quantity"))
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", q.alias("mean_q"), q.alias("median_q"), q.alias("mode_q"))
    d = ft.impute(ft.impute(ft.impute(d, ["mean_q"], "mean"), ["median_q"], "median"), ["mode_q"], "mode")
    return d.withColumn("mean_q", F.round("mean_q", 6))


def _metrics(t: Tables):
    return t.events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value")


_LATEST = "SELECT user_id AS run_id, event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2"


@query("experiment_metrics", "M24", _LATEST)
def experiment_metrics(t: Tables):
    return ml.latest_metrics(_metrics(t))


@query("experiment_best_run", "M24 O6", f"WITH l AS ({_LATEST}) " + " UNION ALL ".join(
    f"SELECT '{w}' AS which, * FROM (SELECT run_id, name, value FROM l WHERE name = 'click' ORDER BY value {d}, run_id LIMIT 1)" for w, d in (("max", "DESC"), ("min", "ASC"))))
def experiment_best_run(t: Tables):
    parts = [ml.best_run(_metrics(t), "click", up).select(F.lit(w).alias("which"), "run_id", "name", "value") for w, up in (("max", True), ("min", False))]
    return parts[0].unionByName(parts[1])
