"""Recommendations against all scores, with items in many groups."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ml


def factors(spark, n, rank, seed, scale):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((rng.normal(size=(n, rank)) * scale(np.arange(n)[:, None])).astype(np.float32))]
    return spark.createDataFrame(rows, "id int, features array<float>"), np.array([v for _, v in rows], np.float32)


@pytest.mark.parametrize("chunk", [7, 60, 1000])
@pytest.mark.parametrize("n", [1, 5, 400])
def test_all_of_the_best_items_are_found(spark, monkeypatch, chunk, n):
    monkeypatch.setattr(ml, "ITEM_CHUNK", chunk, raising=False)
    (users, u), (items, v) = factors(spark, 50, 4, 1, lambda i: 1 + i % 3), factors(spark, 300, 4, 2, lambda i: 1 / (1 + i % 50))
    model = SimpleNamespace(userFactors=users, itemFactors=items, getUserCol=lambda: "u", getItemCol=lambda: "i")
    asked = spark.range(0, 70, 2).select(F.col("id").cast("int").alias("u"))  # some users are not known
    got = {}
    for r in ml.recommend(model, asked.union(asked), n).collect():
        got.setdefault(r["u"], []).append((r["rating"], r["i"]))
    scores = u @ v.T
    assert set(got) == set(range(0, 50, 2))
    for k, found in got.items():
        assert len({i for _, i in found}) == len(found) == min(n, 300)
        assert np.allclose(sorted((s for s, _ in found), reverse=True), -np.sort(-scores[k])[:n], rtol=1e-4)
        assert np.allclose([s for s, _ in found], scores[k][[i for _, i in found]], rtol=1e-4, atol=1e-6)


def test_short_items_are_not_met(spark, monkeypatch):
    """Items too short to reach a user's scores go to no task."""
    monkeypatch.setattr(ml, "ITEM_CHUNK", 10)
    rows = [(i, [100.0, 0.0] if i < 10 else [0.1, 0.1]) for i in range(200)]
    items, users = spark.createDataFrame(rows, "id int, features array<float>"), spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "id int, features array<float>")
    kept, plain = [], ml.materialize
    monkeypatch.setattr(ml, "materialize", lambda df, label: kept.append((label, out := plain(df, label))) or out)
    model = SimpleNamespace(userFactors=users, itemFactors=items, getUserCol=lambda: "u", getItemCol=lambda: "i")
    assert ml.recommend(model, users.select(F.col("id").alias("u")), 5).count() == 100
    assert dict(kept)["asked"].isEmpty()


def test_distinct_keys_are_found_once(spark, root, monkeypatch):
    """Numbering looks at its rows several times: they are stored, not grouped anew each time."""
    from tidemark.plans import learning
    from tidemark.session import Tables

    plans, running = [], learning.running
    monkeypatch.setattr(learning, "running", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or running(df, *a, **k))
    rows = learning._ratings(Tables(spark, root))
    assert len(plans) == 2 and not any("Aggregate" in p for p in plans)
    for side in ("user", "item"):
        pairs = sorted(tuple(r) for r in rows.select(f"{side}_key", side).distinct().collect())
        assert [n for _, n in pairs] == list(range(1, len(pairs) + 1))


def test_blocks_follow_the_ratings(spark, monkeypatch):
    """A task of the factorisation holds a block, so blocks are of bounded size; few ratings have Spark's ten."""
    rows = [(u, i, float((u * 7 + i * i) % 5)) for u in range(60) for i in range(u % 3, 40, 3)]
    data = spark.createDataFrame(rows, "u int, i int, r float")
    plain = ml.ALS(rank=8, maxIter=5, regParam=0.01, userCol="u", itemCol="i", ratingCol="r", seed=ml.SEED).fit(data)
    factors = lambda m: sorted(map(tuple, m.userFactors.collect() + m.itemFactors.collect()))
    few = ml.factorize(data, "u", "i", "r", iterations=5)
    assert few.userFactors.rdd.getNumPartitions() == few.itemFactors.rdd.getNumPartitions() == 10
    assert factors(few) == factors(plain)
    monkeypatch.setattr(ml, "BLOCK_RATINGS", 25, raising=False)
    many = ml.factorize(data, "u", "i", "r", iterations=5)
    assert many.userFactors.rdd.getNumPartitions() == many.itemFactors.rdd.getNumPartitions() == len(rows) // 25 + (len(rows) % 25 > 0) > 10
    error = [ml.regression_metrics(m.transform(data), "r").first()["rmse"] for m in (few, many)]
    assert many.transform(data).count() == len(rows) and abs(error[0] - error[1]) < 0.1


def test_recommendations_come_from_bounded_blocks(spark, root, monkeypatch):
    from tidemark.plans import learning

    models, plain = [], ml.recommend
    monkeypatch.setattr(ml, "BLOCK_RATINGS", 400, raising=False)
    monkeypatch.setattr(ml, "recommend", lambda model, *a: models.append(model) or plain(model, *a))
    rows = learning.recommend_items(learning.Tables(spark, root))
    ratings = learning._ratings(learning.Tables(spark, root)).count()
    assert models[0].userFactors.rdd.getNumPartitions() == -(-ratings // 400) > 10
    assert {n for (n,) in rows.groupBy("user").count().select("count").distinct().collect()} == {5}
