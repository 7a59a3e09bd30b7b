"""Model selection: folds, halving and held-out metrics recounted in SQL."""

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import automl, ml
from tidemark.session import materialize


def table(spark, n=400):
    rows = [(i, float((i * 7919 % 1000) > 500) if i % 10 else float(i % 20 == 0), float(i * 7919 % 1000), float(i % 13)) for i in range(n)]
    df = ml.assemble(spark.createDataFrame(rows, "id long, label double, a double, b double"), ["a", "b"])
    return materialize(automl.deal(df, "id", 10), "dealt")


CHOICES = {"logistic": {"regParam": (0.01, 100.0)}, "forest": {"numTrees": (2, 5), "maxDepth": (2,)}}


def test_folds_do_not_depend_on_partitions(spark):
    keys = spark.createDataFrame([(None,), *((i,) for i in range(200))], "id long")
    one, other = ({r["id"]: r["fold"] for r in automl.deal(keys.repartition(n), "id", 7).collect()} for n in (1, 9))
    assert one == other and set(one.values()) == set(range(7))
    pairs = automl.deal(keys.withColumn("x", F.lit("y")), ["id", "x"], 7)
    assert pairs.columns == ["id", "x", "fold"] and pairs.where("fold is null").isEmpty()


def test_report_is_a_recount_of_the_winner(spark, tmp_path):
    data = table(spark)
    report, model = automl.halving(data, automl.grid({k: ml.classifiers(5)[k] for k in CHOICES}, CHOICES), "binary", parallelism=2)
    rows = report.collect()
    tried = [r for r in rows if r["scope"] == "validation"]
    assert len(tried) == 4 and {(r["trainer"], r["params"]) for r in tried} == {("logistic", "regParam=0.01"), ("logistic", "regParam=100.0"), ("forest", "numTrees=2, maxDepth=2"), ("forest", "numTrees=5, maxDepth=2")}
    won = [r for r in rows if r["status"] == "won"]
    assert [r["scope"] for r in won] == ["validation", "test"] and rows[0] == won[0]
    assert sorted(r["rung"] for r in tried) == [0, 0, 1, 2] and won[0]["rung"] == 2
    path = str(tmp_path / "predicted")
    ml.score_binary(model, data).select("fold", "label", "prediction", "score").write.parquet(path)
    con = duckdb.connect()
    sql = f"""
with p as (select * from read_parquet('{path}/*.parquet')),
r as (select fold, label, rank() over (partition by fold order by score) + (count(*) over (partition by fold, score) - 1) / 2.0 k from p),
a as (select fold, (sum(k) filter (label = 1) - n1 * (n1 + 1) / 2) / (n1 * n0) auc from r join (select fold, count(*) filter (label = 1) n1, count(*) filter (label = 0) n0 from p group by fold) using (fold) group by fold, n1, n0)
select p.fold, count(*), avg((label = prediction)::double), count(*) filter (label = 1 and prediction = 1) / count(*) filter (label = 1), any_value(auc) from p join a using (fold) where p.fold >= 8 group by 1 order by 1"""
    for r, (_, n, accuracy, recall, auc) in zip(won, con.execute(sql).fetchall(), strict=True):
        assert r["measured_rows"] == n and abs(r["accuracy"] - accuracy) < 1e-12 and abs(r["recall"] - recall) < 1e-12 and abs(r["auc"] - auc) < 1e-12
    assert won[0]["train_rows"] == con.execute(f"select count(*) from read_parquet('{path}/*.parquet') where fold < 8").fetchone()[0]


def test_the_better_half_goes_on(spark, monkeypatch):
    """With known metrics the rungs are those of a halving by hand."""
    data, value = table(spark, 100), {"a": 0.5, "b": 0.9, "c": 0.9, "d": None, "e": 0.7}
    monkeypatch.setattr(ml, "train", lambda df, est, label: est)
    monkeypatch.setattr(automl, "measured", lambda model, df, kind, label: {"accuracy": value[model]})
    candidates = [automl.Candidate(n, (), n) for n in value]
    rows = automl.halving(data, candidates, "binary", keep=0.6)[0].collect()
    assert [(r["trainer"], r["rung"], r["status"], r["scope"]) for r in rows] == [
        ("b", 2, "won", "validation"), ("b", 2, "won", "test"), ("c", 1, "dropped", "validation"), ("e", 1, "dropped", "validation"), ("a", 0, "dropped", "validation"), ("d", 0, "dropped", "validation")]


def test_candidates_beyond_the_budget_are_reported(spark, monkeypatch):
    data, clock = table(spark, 100), iter(range(0, 1000, 10))
    monkeypatch.setattr(ml, "train", lambda df, est, label: est)
    monkeypatch.setattr(automl, "measured", lambda model, df, kind, label: {"r2": 1.0})
    monkeypatch.setattr(automl.time, "monotonic", lambda: next(clock))
    rows = automl.halving(data, [automl.Candidate(n, (), n) for n in "abc"], "regression", parallelism=1, budget_seconds=25)[0].collect()
    assert {r["trainer"]: r["status"] for r in rows} == {"a": "won", "b": "dropped", "c": "not reached"}
    with pytest.raises(ValueError):
        automl.halving(data, [], "regression")


@pytest.mark.parametrize("trainer", ["logistic", "forest", "gbt"])
def test_binary_models_predict_after_an_observation(spark, trainer):
    """A session that has used an observation cannot be sent to executors; models must not hold it."""
    session, seen = spark.newSession(), Observation()
    data = table(session)
    data.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 400}
    model = ml.train(data, ml.classifiers(2)[trainer])
    assert automl.measured(model, data, "binary")["accuracy"] > 0.5
    report, _ = ml.compare(data, None, {trainer: ml.classifiers(2)[trainer]}, "binary")
    assert [r["trainer"] for r in report.collect()] == [trainer]
