import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tripmill.functions import labels as text
from tripmill.functions.geometry import with_nearest
from tripmill.functions.priority import hash_priority, portable_priority
from tripmill.operators import anomalies, profiles, projection, quality, quantiles, sampling, scaling
from tripmill.schema import FEATURES, ROW_ID
from tripmill.sources.synthetic import synthetic_trips


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"{name} double")


# ---- quantiles ----


def test_interpolated_percentile(spark):
    found = quantiles.quantiles(numbers(spark, [1, 2, 4, 9]), {"x": [0.99]})
    assert found["x", 0.99] == pytest.approx(8.85)


@pytest.mark.parametrize(("seed", "sketch_rows"), [(1, 10**9), (2, 10**9), (3, 10), (4, 10)])
def test_narrowing_equals_brute_force(spark, monkeypatch, seed, sketch_rows):
    """A third of the rows share one value, the rest spread over many magnitudes."""
    monkeypatch.setattr(quantiles, "SKETCH_ROWS", sketch_rows)
    monkeypatch.setattr(quantiles, "LISTED_ROWS", 5)
    monkeypatch.setattr(quantiles, "BINS", 16)
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.full(300, 2.5), rng.normal(size=300), 10.0 ** rng.uniform(-8, 8, 300)])
    shares = [0.0, 0.01, 0.25, 0.5, 0.66, 0.99, 1.0]
    found = quantiles.quantiles(numbers(spark, values).repartition(3), {"x": shares}, exact_rows=0)
    for share in shares:
        assert found["x", share] == pytest.approx(np.quantile(values, share), rel=1e-12)


def test_a_wrong_sketch_is_not_used(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ROWS", 10)
    other = quantiles.known_columns(quantiles.column_statistics(numbers(spark, range(-900, -800)), ["x"]))["x"]
    own = quantiles.known_columns(quantiles.column_statistics(numbers(spark, range(1, 102)), ["x"]))["x"]
    wrong = {"x": Row(**{**own.asDict(), "sketch": other["sketch"]})}
    found = quantiles.quantiles(numbers(spark, range(1, 102)), {"x": [0.25, 0.5]}, exact_rows=0, known=wrong)
    assert found == {("x", 0.25): 26.0, ("x", 0.5): 51.0}


def test_statistics_of_parts_are_merged(spark, monkeypatch):
    """A table that grows by parts is summed up from their saved rows, exactly."""
    monkeypatch.setattr(quantiles, "SKETCH_ROWS", 10)
    rng = np.random.default_rng(7)
    parts = [rng.normal(5, 3, 400), np.full(150, 2.5), rng.normal(-9, 1, 77)]
    saved = [quantiles.column_statistics(numbers(spark, [*part, None]), ["x"]) for part in parts]
    merged = quantiles.merged_statistics(saved[0].unionByName(saved[1]).unionByName(saved[2]))
    values = np.concatenate(parts)
    df = numbers(spark, [*values, None, None, None])
    row = profiles.feature_summary(df, ["x"], 0, merged).first()
    assert (row["count"], row["null_count"]) == (len(values), 3)
    assert row["mean"] == pytest.approx(values.mean()) and row["std"] == pytest.approx(values.std(ddof=1))
    assert (row["min"], row["max"]) == (values.min(), values.max())
    for share, name in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%")):
        assert row[name] == pytest.approx(np.quantile(values, share), rel=1e-12)


def test_large_summaries_take_two_scans(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ROWS", 100)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    values = np.random.default_rng(1).normal(size=1000)
    df = numbers(spark, values)
    row = profiles.feature_summary(df.mapInArrow(counted, df.schema), ["x"], 0).first()
    assert read.value == 2 * len(values) and row["50%"] == pytest.approx(np.median(values))


def test_quantiles_skip_nulls_and_handle_empty_columns(spark):
    df = numbers(spark, [None, 1, None, 3])
    assert quantiles.quantiles(df, {"x": [0.5]})["x", 0.5] == 2
    assert quantiles.quantiles(df, {"x": [0.5]}, exact_rows=0)["x", 0.5] == 2
    assert quantiles.quantiles(df.filter("x IS NULL"), {"x": [0.5]})["x", 0.5] is None


def test_rank_out_of_range(spark):
    with pytest.raises(ValueError, match="no rank 4"):
        quantiles.find_ranks(numbers(spark, [1, 2, 4, 9]), {"x": [4]})


# ---- samples ----


def ids(df):
    return {r[ROW_ID] for r in df.select(ROW_ID).collect()}


@pytest.mark.parametrize("priority", [hash_priority, portable_priority])
def test_prefixes_nest_and_both_paths_agree(spark, priority):
    rows = spark.range(3000).withColumnRenamed("id", ROW_ID)
    top = ids(sampling.sample_rows(rows, 500, priority=priority))
    cut = ids(sampling.sample_rows(rows.repartition(5), 500, priority=priority, top_n_rows=10))
    assert top == cut and len(top) == 500
    assert top < ids(sampling.sample_rows(rows, 900, priority=priority))
    assert ids(sampling.sample_rows(rows, 500, seed=7, priority=priority)) != top
    assert len(ids(sampling.sample_rows(rows, 9999, top_n_rows=10))) == 3000


def test_equal_priorities_are_cut_by_key(spark):
    tied = spark.range(100).select(F.col("id").alias(ROW_ID), (F.col("id") % 2).alias("priority"))
    kept = tied.filter(sampling.prefix_cut(tied, 70))
    assert ids(kept) == set(range(0, 100, 2)) | set(range(1, 41, 2))


def test_holdout_follows_training(spark):
    rows = spark.range(400).withColumnRenamed("id", ROW_ID)
    training, holdout = ids(sampling.sample_rows(rows, 100)), ids(sampling.holdout_rows(rows, 100))
    assert len(holdout) == 30 and not training & holdout
    assert training | holdout == ids(sampling.sample_rows(rows, 130))


def test_large_holdout_uses_the_cut(spark, monkeypatch):
    rows = spark.range(400).withColumnRenamed("id", ROW_ID)
    small = ids(sampling.holdout_rows(rows, 100))
    monkeypatch.setattr(sampling, "TOP_N_ROWS", 50)
    assert ids(sampling.holdout_rows(rows, 100)) == small


def test_ranks_of_any_number_of_rows(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 5).withColumnRenamed("id", ROW_ID)
    small = {r[ROW_ID]: r["rank"] for r in sampling.ranked_sample(rows, 900).collect()}
    monkeypatch.setattr(sampling, "TOP_N_ROWS", 50)
    monkeypatch.setattr(sampling, "RANK_BIN_ROWS", 100)
    large = {r[ROW_ID]: r["rank"] for r in sampling.ranked_sample(rows, 900).collect()}
    assert large == small and sorted(large.values()) == list(range(1, 901))
    every = [r["rank"] for r in sampling.ranked_sample(rows, 10_000).collect()]
    assert sorted(every) == list(range(1, 3001))
    assert sampling.holdout_rows(rows, 3000).count() == 0
    assert sampling.holdout_rows(rows, 2990).count() == 10


def test_top_n_reads_little_more_than_n(spark):
    ranked = sampling.with_priority(spark.range(20_000).withColumnRenamed("id", ROW_ID))
    near = sampling.near_prefix(ranked, 400)
    assert 400 <= near.count() <= 800
    first = [r[ROW_ID] for r in ranked.orderBy("priority", ROW_ID).limit(400).collect()]
    assert {r[ROW_ID] for r in near.orderBy("priority", ROW_ID).limit(400).collect()} == set(first)


def test_hash_blocks_cover_everything_evenly(spark):
    rows = spark.range(5000).select(hash_priority(F.col("id")).alias("p"))
    counts = rows.groupBy(sampling.hash_block(F.col("p"), 5).alias("b")).count().collect()
    assert {r["b"] for r in counts} == set(range(5))
    assert all(850 < r["count"] < 1150 for r in counts)


# ---- scaling ----


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    df = numbers(spark, [1, 2, 3, 4], "trip_distance").withColumn("duration_minutes", F.lit(5.0))
    scaler = scaling.fit_scaler(df, ("trip_distance", "duration_minutes"))
    assert scaler.mean == (2.5, 5.0) and scaler.samples_seen == 4
    assert scaler.scale == (pytest.approx(np.std([1, 2, 3, 4])), 1.0)
    z = [r[0] for r in scaling.with_scaled(df, scaler).select("z_trip_distance").collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)


def test_scaler_snapshot_round_trip_and_checks(spark):
    df = synthetic_trips(spark, 30).select("trip_distance", F.col("fare_amount").alias("speed_mph"))
    scaler = scaling.fit_scaler(df, ("trip_distance", "speed_mph"))
    saved = scaling.snapshot(scaler, 2, {}, 42, "digest", 30)
    assert scaling.restore_scaler(saved) == scaler
    assert scaling.scaler_from_table(scaling.scaler_table(spark, scaler)) == scaler
    for key, value, message in (("scale", 0.0, "positive"), ("mean", float("nan"), "finite")):
        state = {**saved["scaler"], key: [value, 1.0]}
        with pytest.raises(ValueError, match=message):
            scaling.restore_scaler({**saved, "scaler": state})
    with pytest.raises(ValueError, match="distinct names"):
        scaling.restore_scaler({**saved, "features": ["vendor", "speed_mph"]})
    centers = np.array([[0.0, 0.0], [1.0, -1.0]])
    units = scaling.unscale_centers(scaler, centers)
    assert units[0].tolist() == list(scaler.mean)


def test_reconcile(spark):
    scaler = scaling.Scaler(("trip_distance",), (1.0,), (2.0,), (4.0,), 9)
    saved = scaling.snapshot(scaler, 3, {}, 42, "abc", 9)
    scaling.reconcile({"sha256": "abc", "accepted_rows": 9}, saved)
    with pytest.raises(ValueError, match="cleaned_rows"):
        scaling.reconcile({"sha256": "abc", "accepted_rows": 8}, saved)


# ---- assignment ----


def test_ties_go_to_the_lowest_cluster_on_both_paths(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (9.0, 9.0)], "a double, b double")
    centers = np.array([[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]])
    narrow = with_nearest(df, ["a", "b"], centers).orderBy("a").collect()
    assert [r["cluster"] for r in narrow] == [0, 0, 0]
    packed = df.select("a", F.array("a", "b").alias("v"))
    wide = with_nearest(packed, "v", centers).orderBy("a").collect()
    assert [r["cluster"] for r in wide] == [0, 0, 0]
    assert [r["squared_distance"] for r in wide] == [r["squared_distance"] for r in narrow]


def test_wide_models_agree_with_literals(spark):
    rng = np.random.default_rng(0)
    x, centers = rng.normal(size=(200, 4)), rng.normal(size=(60, 4))
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double, d double")
    labels = [r["cluster"] for r in with_nearest(df, list("abcd"), centers).collect()]
    expected = ((x[:, None, :] - centers) ** 2).sum(axis=2).argmin(axis=1)
    assert labels == expected.tolist()


# ---- quality ----


def brute_silhouette(x, labels):
    gaps = np.sqrt(((x[:, None, :] - x) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        inner = gaps[i, same].sum() / (same.sum() - 1)
        outer = min(gaps[i, labels == c].mean() for c in set(labels) - {own})
        scores.append((outer - inner) / max(inner, outer))
    return float(np.mean(scores))


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    labels = rng.integers(0, 4, 120)
    labels[0] = 9
    rows = [(*map(float, p), int(c), 1, i) for i, (p, c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "a double, b double, c double, l int, same int, each int")
    found = quality.silhouettes(df, ["a", "b", "c"], ["l", "same", "each"])
    assert found["l"] == pytest.approx(brute_silhouette(x, labels), abs=1e-12)
    assert found["same"] is None and found["each"] is None


def rand_by_pairs(a, b):
    from itertools import combinations

    pairs = list(combinations(range(len(a)), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    left, right = (sum(c[i] == c[j] for i, j in pairs) for c in (a, b))
    expected, most = left * right / len(pairs), (left + right) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ([0, 0, 1, 1], [1, 1, 0, 0]),
        ([0, 0, 1, 1], [0, 1, 0, 1]),
        ([0, 0, 0, 0], [0, 0, 0, 0]),
        ([0, 0, 1, 2, 2, 2], [1, 1, 1, 0, 0, 2]),
    ],
)
def test_adjusted_rand(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert quality.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(rand_by_pairs(a, b))


def test_adjusted_rand_by_group_and_null_labels(spark):
    rows = [(k, x, y) for k in (2, 3) for x, y in [(0, 1), (0, 1), (1, 0), (1, 0 if k == 2 else 1)]]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    found = {r["k"]: r["ari"] for r in quality.adjusted_rand(df, "a", "b", ["k"]).collect()}
    assert found[2] == 1.0 and found[3] < 1.0


def test_empty_clusters_count(spark):
    labeled = spark.createDataFrame([(0,), (0,), (2,)], "cluster int")
    sizes = quality.cluster_sizes(labeled, 4)
    assert {r["cluster"]: r["size"] for r in sizes.collect()} == {0: 2, 1: 0, 2: 1, 3: 0}
    shares = quality.size_shares(sizes).first()
    assert shares["cluster_sizes"] == [2, 0, 1, 0] and shares["min_cluster_share"] == 0


# ---- anomalies ----


def test_percentile_bounds(spark):
    for bad in (0, 100, -1):
        with pytest.raises(ValueError, match="percentile"):
            anomalies.distance_threshold(numbers(spark, [1], "centroid_distance"), bad)


def test_flags_are_strict_and_zero_thresholds_are_safe(spark):
    df = numbers(spark, [0, 1, 2], "centroid_distance")
    rows = anomalies.with_flags(df, 1.0).collect()
    assert [r["distance_outlier"] for r in rows] == [False, False, True]
    zero = anomalies.with_flags(df, 0.0).collect()
    assert zero[0]["anomaly_ratio"] == 0 and zero[1]["anomaly_ratio"] == 1e12


def test_histogram(spark):
    found = anomalies.histogram(numbers(spark, [0, 1, 2, 9, 10]), "x", 10).orderBy("bin").collect()
    assert [(r["bin"], r["rows"]) for r in found] == [(0, 1), (1, 1), (2, 1), (9, 2)]
    same = anomalies.histogram(numbers(spark, [4, 4]), "x").collect()
    assert [(r["bin"], r["rows"]) for r in same] == [(0, 2)]
    assert anomalies.histogram(numbers(spark, []), "x").count() == 0


def test_severity_is_strict(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 2.1), (1, 6.0)], "cluster int, anomaly_ratio double")
    assert anomalies.severity_rows(df, 2).count() == 2
    assert anomalies.severity_rows(df, 2, cluster=0).count() == 1
    counts = {r["cluster"]: r["above_5x"] for r in anomalies.severity_counts(df).collect()}
    assert counts == {0: 0, 1: 1}


# ---- text and views ----


def test_profile_text(spark):
    row = spark.range(1).select(
        text.profile_text(*[F.lit(v) for v in (2.0026, 11.85, 10.16, -0.6805, 0.3317)]).alias("clear"),
        text.profile_text(*[F.lit(v) for v in (13.08, 35.5, 24.5, -0.24, -0.15)]).alias("mixed"),
        text.circular_hour(F.lit(-0.6805), F.lit(0.3317)).alias("hour"),
    ).first()
    assert row["clear"] == "2.0 mi · 12 min · 10 mph average · pickup around 20:00"
    assert row["mixed"] == "13.1 mi · 36 min · 24 mph average · mixed pickup hours"
    assert row["hour"] == pytest.approx(19.73, abs=0.01)


def test_hours_near_midnight_wrap(spark):
    row = spark.range(1).select(
        text.profile_text(*[F.lit(v) for v in (1.0, 1.0, 1.0, -0.05, 0.99)]).alias("t")
    ).first()
    assert row["t"].endswith("around 00:00")


def test_descriptions_have_a_default(spark):
    means = {name: 0.5 for name in FEATURES}
    known = spark.createDataFrame([(0, *means.values())], ["cluster", *means])
    rows = spark.createDataFrame([(0,), (7,)], "cluster int")
    found = {r["cluster"]: r["cluster_description"] for r in profiles.describe_clusters(rows, known).collect()}
    assert found[7] == "Profile unavailable" and "mi ·" in found[0]


def test_labels_and_distribution(spark):
    rows = spark.createDataFrame([(0,), (0,), (1,)], "cluster int")
    sizes = profiles.with_share(profiles.distribution(rows))
    assert {(r["cluster"], r["size"], r["share"]) for r in sizes.collect()} == {(0, 2, 2 / 3), (1, 1, 1 / 3)}
    assert profiles.distribution(sizes.drop("share")).count() == 2
    assert rows.select(text.cluster_label(F.col("cluster"))).first()[0] == "Cluster 0"


def test_view_coordinates(spark):
    rows = spark.range(50).select(
        F.col("id").alias(ROW_ID), *[F.sin(F.col("id") * i).alias(n) for i, n in enumerate("abc", 1)]
    )
    axes = projection.fit_axes(rows, list("abc"))
    placed = projection.attach_coordinates(rows, list("abc"), axes, chart_rows=20)
    assert placed.count() == 50
    assert projection.charted(placed, 2).count() == projection.charted(placed, 3).count() == 20
    assert projection.charted(rows, 2) is None
    assert projection.charted(placed.limit(0), 2).count() == 0
    assert set(projection.fit_axes(rows, ["a"])) == set()
    assert set(projection.fit_axes(rows, ["a", "b"])) == {2}


def test_statistic_rows(spark):
    df = spark.range(1, 6).select(F.col("id").cast("double").alias("trip_distance"))
    summary = profiles.feature_summary(df, ["trip_distance"])
    found = {r["statistic"]: r["trip_distance"] for r in profiles.statistic_rows(summary).collect()}
    assert found["count"] == 5 and found["50%"] == 3 and found["std"] == pytest.approx(np.std([1, 2, 3, 4, 5], ddof=1))
