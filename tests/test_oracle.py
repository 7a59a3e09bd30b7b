"""Every registered query against its SQL, and the plans for hot groups against the same SQL."""

import pytest
from compare import duck_result, mismatch, spark_result

import __spark_entry__ as entry
from tidemark.plans import COVERS, ORACLES, QUERIES, learning

# trained models and masked text have no SQL form; they are tested by value elsewhere.
# These train for minutes at full length, so the test shortens them.
SLOW = {"compare_binary_classifiers", "compare_multiclass_classifiers", "compare_regressors", "regression_ensemble", "automl_binary", "automl_multiclass", "automl_regression",
        "kmeans_choose_k", "factorization_metrics", "recommend_items"}
SPLIT = ["flag_statistics_ranked", "supplier_order_statistics", "event_metric_snapshot", "lookup_orders", "theta_count", "asof_join", "pivot_every_aggregate",
         "self_join", "binary_metrics", "quantile_bins", "profile_numeric", "series_trend", "series_autocorrelation", "series_gap_fill", "series_change_points",
         "series_time_weighted_average", "geo_polygon_join", "session_windows", "window_ranking", "window_distribution", "window_offsets", "window_running", "window_user_frames"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, root, name):
    assert mismatch(spark_result(spark, QUERIES[name], root), duck_result(con, ORACLES[name])) is None


@pytest.mark.parametrize("name", SPLIT)
def test_hot_group_plan_matches_sql(spark, con, root, split, name):
    assert mismatch(spark_result(spark, QUERIES[name], root), duck_result(con, ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, root, monkeypatch, name):
    if name in SLOW:
        monkeypatch.setattr(learning, "ROUNDS", 3)
    df = QUERIES[name](spark, root)
    assert df.columns and len(df.collect()) > 0  # a count would prune the columns away


def test_contract(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(COVERS[n] for n in QUERIES)
