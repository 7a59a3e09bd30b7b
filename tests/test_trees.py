"""Trees over histograms against Spark ML's, and against sums by hand."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml import regression as R

from tidemark.operators import automl, ml, trees
from tidemark.session import materialize


def table(spark, n=1500, seed=3):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = r.randrange(20), r.randrange(9), r.randrange(3)
        rows.append((float(a), float(b) / 4, float(c), 100 + a * b - 30 * (c == 1) + r.gauss(0, 5)))
    return materialize(ml.assemble(spark.createDataFrame(rows, "a double, b double, c double, label double"), ["a", "b", "c"]), "rows")


def test_boosting_is_that_of_spark(spark, monkeypatch):
    """With few values a feature both have the same candidates, so the same trees."""
    monkeypatch.setattr(trees, "CUT_ROUNDS", 2)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    data = table(spark)
    params = {"maxIter": 5, "maxDepth": 4, "minInstancesPerNode": 10, "stepSize": 0.2}
    want = R.GBTRegressor(seed=1, **params).fit(data).transform(data).collect()
    model = trees.BoostedTrees(**params).fit(data)
    assert np.allclose([r["prediction"] for r in model.transform(data).collect()], [r["prediction"] for r in want], rtol=1e-9)


@pytest.mark.parametrize("driver", [0, 1 << 30])
def test_forest_of_one_tree_and_of_many(spark, monkeypatch, driver):
    monkeypatch.setattr(trees, "DRIVER_BYTES", driver)
    monkeypatch.setattr(trees, "GROUP_BYTES", 100_000)
    data = table(spark)
    want = R.RandomForestRegressor(numTrees=1, maxDepth=5, bootstrap=False, featureSubsetStrategy="all", seed=1).fit(data).transform(data).collect()
    one = [r["prediction"] for r in trees.Forest(numTrees=1, maxDepth=5).fit(data).transform(data).collect()] if driver else None
    plain = ml.train(data, R.RandomForestRegressor(numTrees=30, seed=1))
    r2 = [ml.regression_metrics(m.transform(data)).first().r2 for m in (ml.train(data, trees.Forest(numTrees=30)), plain)]
    assert abs(r2[0] - r2[1]) < 0.06
    if one:
        assert len(set(one)) > 10 and abs(np.mean(one) - np.mean([r["prediction"] for r in want])) < 2


def test_a_level_is_one_job_and_reads_bounded_histograms(spark):
    """No job of Spark ML's tree learner, whose time a round grew with rows times objects."""
    r = ml.regressors(3)
    assert {type(r[k]) for k in ("gbt", "fast_gbt")} == {trees.BoostedTrees} and type(r["forest"]) is trees.Forest
    assert r["fast_gbt"].getStepSize() == 0.2 and r["gbt"].getStepSize() == 0.1 and r["gbt"].getMaxIter() == 3


def test_rare_values_have_thresholds_and_many_values_quantiles(spark):
    rows = spark.range(20_000).selectExpr("array(if(id = 7, 5.0D, cast(id % 3 as double)), sqrt(id), 1.0D) x").repartition(4)
    few, many, one = trees.thresholds(rows, 3)
    assert few.tolist() == [0.5, 1.5, 3.5] and one.size == 0
    share = np.searchsorted(np.sort(np.sqrt(np.arange(20_000))), many) / 20_000
    assert many.size == 31 and np.allclose(share, np.arange(1, 32) / 32, atol=0.01)


def test_saved_and_odd_inputs(spark, tmp_path):
    data = table(spark, 200)
    model = ml.train(data, trees.BoostedTrees(maxIter=2))
    ml.save_model(model, str(tmp_path / "m"))
    back = ml.load_model(str(tmp_path / "m"))
    assert isinstance(back, PipelineModel)
    assert [r["prediction"] for r in back.transform(data).collect()] == [r["prediction"] for r in model.transform(data).collect()]
    same = data.selectExpr("features", "2.5D label")
    assert {r["prediction"] for r in ml.train(same, trees.BoostedTrees(maxIter=3)).transform(same).collect()} == {2.5}
    for bad in (data.limit(0), data.selectExpr("features", "if(label > 100, null, label) label")):
        with pytest.raises(ValueError):
            trees.Forest(numTrees=2).fit(bad)


def test_models_fitted_together_are_those_fitted_alone(spark, monkeypatch):
    """Rows are binned once, and no round, tree or level is grown twice."""
    monkeypatch.setattr(trees, "CUT_ROUNDS", 2)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    monkeypatch.setattr(trees, "GROUP_TREES", 3)
    data = table(spark)
    every = [trees.BoostedTrees(maxIter=n, maxDepth=3, minInstancesPerNode=5, stepSize=s) for n, s in ((2, 0.1), (5, 0.3), (4, 0.1))]
    every += [trees.Forest(numTrees=n, maxDepth=d) for n, d in ((2, 6), (5, 2), (5, 4), (1, 3))]
    alone = [ml.train(data, e) for e in every]
    binned, levels, thresholds, grown = [], [], trees.thresholds, trees._grown
    monkeypatch.setattr(trees, "thresholds", lambda *a: binned.append(1) or thresholds(*a))
    monkeypatch.setattr(trees, "_grown", lambda state, depths, *a: levels.append(sum(depths.values())) or grown(state, depths, *a))
    together = ml.train_together(data, every)
    # a first round for both steps, then five of one and four of the other; two trees of six levels and three of four; one tree by itself
    assert len(binned) == 1 and sum(levels) == 3 * (1 + 4 + 3) + 2 * 6 + 3 * 4 + 3
    for e, a, b in zip(every, alone, together, strict=True):
        one, other = ([r["prediction"] for r in m.transform(data).collect()] for m in (a, b))
        assert np.allclose(one, other, rtol=1e-9) and len(b.stages[0].trees()) == len(a.stages[0].trees()), e


def test_a_rung_bins_its_rows_once(spark, monkeypatch):
    data, binned, thresholds = automl.deal(table(spark, 600), "label", 10), [], trees.thresholds
    monkeypatch.setattr(trees, "thresholds", lambda *a: binned.append(1) or thresholds(*a))
    choices = {"linear": {"regParam": (0.01,)}, "forest": {"numTrees": (2, 3)}, "gbt": {"maxIter": (2, 3)}}
    report = automl.halving(materialize(data, "dealt"), automl.grid({k: ml.regressors(3)[k] for k in choices}, choices), "regression")[0].collect()
    assert len(report) == 6 and len(binned) <= 3
