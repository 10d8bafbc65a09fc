import pytest
from pyspark.sql import functions as F

from tripmill.operators import results

SCHEMA = (
    "algorithm string, rows bigint, status string, environment string, seed int, k int,"
    " feature_count int, streaming boolean, experiment_id string"
)


@pytest.fixture
def local(spark):
    return spark.createDataFrame(
        [("KMeans", 50, "skipped_memory_preflight", "local", 42, 2, 6, False, "fixture")], SCHEMA
    )


@pytest.fixture
def imported(local):
    return local.withColumns({"environment": F.lit("colab"), "rows": F.lit(100).cast("bigint")})


def test_local_alone(local):
    assert results.combine_results(local.drop("environment")).first()["environment"] == "local"


def test_valid_import(local, imported):
    both = results.combine_results(local, imported.withColumn("note", F.lit("x")))
    assert sorted(r["environment"] for r in both.collect()) == ["colab", "local"]
    assert "note" in both.columns


def test_types_are_widened(local, imported):
    both = results.combine_results(local, imported.withColumn("rows", F.lit("100")))
    assert both.schema["rows"].dataType.simpleString() == "string"
    assert both.count() == 2


@pytest.mark.parametrize(
    ("column", "value", "message"),
    [
        ("experiment_id", "'other'", "experiment_id"),
        ("experiment_id", "CAST(NULL AS STRING)", "experiment_id"),
        ("k", "9", "k "),
        ("environment", "'local'", "environment"),
        ("environment", "CAST(NULL AS STRING)", "environment"),
        ("algorithm", "'DBSCAN'", "algorithm"),
        ("status", "'done'", "status"),
        ("status", "'ok'", "fit_seconds"),
        ("rows", "0L", "rows"),
    ],
)
def test_refused_imports(local, imported, column, value, message):
    with pytest.raises(ValueError, match=message):
        results.combine_results(local, imported.withColumn(column, F.expr(value)))


@pytest.mark.parametrize(
    ("metric", "value", "fine"),
    [
        ("silhouette", 1.5, False),
        ("silhouette", -0.5, True),
        ("fit_seconds", -1.0, False),
        ("normalized_inertia", float("nan"), False),
        ("fit_seconds", float("inf"), False),
        ("fit_seconds", 0.0, True),
    ],
)
def test_metrics_of_successful_rows(local, imported, metric, value, fine):
    values = {name: F.lit(0.5) for name in results.METRICS} | {metric: F.lit(value)}
    rows = imported.withColumns({"status": F.lit("ok"), **values})
    if fine:
        assert results.combine_results(local, rows).count() == 2
    else:
        with pytest.raises(ValueError, match=metric):
            results.combine_results(local, rows)


def test_missing_columns_and_empty_imports(local, imported):
    with pytest.raises(ValueError, match="seed, streaming"):
        results.combine_results(local, imported.drop("seed", "streaming"))
    with pytest.raises(ValueError, match="empty"):
        results.combine_results(local, imported.limit(0))


def test_pairs_need_equal_rows_and_environment(spark):
    rows = [
        ("KMeans", 50, "local", False, "ok", 0.4),
        ("MiniBatchKMeans", 50, "local", False, "ok", 0.1),
        ("MiniBatchKMeans", 50, "local", True, "ok", 0.2),
        ("KMeans", 100, "local", False, "ok", 0.8),
        ("MiniBatchKMeans", 100, "colab", False, "ok", 0.3),
        ("KMeans", 200, "local", False, "failed", None),
        ("MiniBatchKMeans", 200, "local", False, "ok", 0.5),
    ]
    df = spark.createDataFrame(
        rows, "algorithm string, rows int, environment string, streaming boolean, status string, fit_seconds double"
    )
    row = results.largest_pair(df, ["fit_seconds"]).first()
    assert (row["rows"], row["kmeans_fit_seconds"], row["minibatch_fit_seconds"]) == (50, 0.4, 0.1)
    chart = results.comparison_rows(df)
    assert chart.count() == 6
    series = {r["series"] for r in chart.collect()}
    assert "local · MiniBatchKMeans · streaming" in series and "local · KMeans" in series


def test_identity_ignores_key_order(spark):
    assert results.experiment_id({"a": 1, "b": [2]}) == results.experiment_id({"b": [2], "a": 1})
    assert results.experiment_id({"a": 1}) != results.experiment_id({"a": 2})
