"""Radius joins: cut cells against all pairs, and how the pairs are dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import geo


def points(spark, name, n, spots):
    """``n`` points around a few spots, so that single cells hold many of them."""
    rows = [(i, spots[i % len(spots)][0] + (i * 37 % 101) / 100, spots[i % len(spots)][1] + (i * 61 % 103) / 50) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, lat double, lon double")


@pytest.mark.parametrize("sizes", [(300, 400), (600, 3), (3, 600)])
@pytest.mark.parametrize("km", [5.0, 90.0, 400.0])
def test_cut_cells_give_all_pairs_once(spark, monkeypatch, sizes, km):
    monkeypatch.setattr(geo, "TASK_PAIRS", 50)
    spots = [(10.0, 179.2), (10.5, -179.9), (88.9, 20.0), (-45.0, 0.0)]
    a, b = points(spark, "a", sizes[0], spots), points(spark, "b", sizes[1], spots)
    found = sorted((r["a"], r["b"]) for r in geo.radius_join(a, b, km, a_id="a", b_id="b").collect())
    every = a.crossJoin(b.select("b", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")))
    near = every.where(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= km)
    assert found == sorted((r["a"], r["b"]) for r in near.select("a", "b").collect())


def test_one_hot_cell_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(geo, "TASK_PAIRS", 10_000, raising=False)
    a, b = points(spark, "a", 400, [(10.0, 20.0)]), points(spark, "b", 400, [(10.0, 20.0)])
    tasks = [r["count"] for r in geo.radius_join(a, b, 400, a_id="a", b_id="b").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 400 * 400 and max(tasks) < 400 * 400 / 4
