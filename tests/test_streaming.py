import numpy as np
from pyspark.sql import functions as F

from tripmill.operators import bundle as bundles, cleaning, minibatch, scaling
from tripmill.schema import DISTANCE, FEATURES, REASON, ROW_ID
from tripmill.sources.synthetic import synthetic_trips
from tripmill.streaming import arrivals


def arrive(spark, folder, start, count):
    trips = synthetic_trips(spark, start + count, 3).filter(F.col(ROW_ID) >= start)
    broken = trips.withColumn(
        DISTANCE, F.when(F.col(ROW_ID) % 10 == 0, 0.0).otherwise(F.col(DISTANCE))
    )
    broken.coalesce(1).write.mode("append").parquet(folder)
    return trips.schema


def test_streamed_rows_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    for start in (0, 40):
        schema = arrive(spark, folder, start, 40)
    stream = arrivals.read_arrivals(spark, folder, schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    arrivals.validate_arrivals(stream, out, checkpoint)
    checked = spark.read.parquet(out)
    batch = cleaning.classify(spark.read.parquet(folder))
    names = [ROW_ID, REASON, *FEATURES]
    assert sorted(map(str, checked.select(*names).collect())) == sorted(map(str, batch.select(*names).collect()))
    # Later arrivals are added by a rerun; earlier files are not read again.
    arrive(spark, folder, 80, 20)
    arrivals.validate_arrivals(stream, out, checkpoint)
    assert spark.read.parquet(out).groupBy(ROW_ID).count().filter("count > 1").count() == 0
    assert spark.read.parquet(out).count() == 100


def test_streamed_scores_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = arrive(spark, folder, 0, 60)
    bundle = bundles.fit_bundle(synthetic_trips(spark, 60), 2, restarts=1, with_projection=False)
    stream = arrivals.read_arrivals(spark, folder, schema)
    arrivals.score_arrivals(stream, bundle, "KMeans", str(tmp_path / "out"), str(tmp_path / "cp"))
    names = [ROW_ID, "cluster", "centroid_distance", "distance_outlier"]
    batch, _, _ = bundles.predict(bundle, spark.read.parquet(folder), "KMeans")
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(streamed.select(*names).collect()) == sorted(batch.select(*names).collect())


def test_positions_in_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = arrive(spark, folder, 0, 25)
    stream = arrivals.positioned(arrivals.read_arrivals(spark, folder, schema))
    arrivals.run_available(stream.select(ROW_ID, "arrival"), str(tmp_path / "o"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted(r[ROW_ID] for r in rows) == list(range(25))
    assert len({r["arrival"] for r in rows}) == 1


def test_each_file_moves_the_model_once(spark, tmp_path):
    folder, steps, checkpoint = (str(tmp_path / name) for name in ("in", "steps", "cp"))
    schema = arrive(spark, folder, 0, 50)
    good, _, _ = bundles.validate(synthetic_trips(spark, 50, 3))
    scaler = scaling.fit_scaler(good, FEATURES)
    columns = scaling.scaled_names(FEATURES)
    start = np.vstack([np.full(6, -0.5), np.full(6, 0.5), np.full(6, 99.0)])

    def run():
        stream = arrivals.read_arrivals(spark, folder, schema)
        arrivals.fit_arrivals(stream, scaler, start, steps, checkpoint, shard=F.col(ROW_ID) % 3)
        return arrivals.current_centers(spark, steps)

    first, weights = run()
    # A start without new files changes nothing, and neither does a lost driver: the batch is in the checkpoint.
    again, same = run()
    assert np.array_equal(first, again) and np.array_equal(weights, same) and weights.sum() == 45
    arrive(spark, folder, 50, 30)
    second, weights = run()
    assert not np.array_equal(first, second) and weights.sum() == 72
    assert weights[2] == 0 and np.array_equal(second[2], start[2])
    # The same updates one after another, shard by shard.
    expected = []
    for shard in range(3):
        centers, held = start, np.zeros(3)
        for begin, end in ((0, 50), (50, 80)):
            trips = synthetic_trips(spark, end, 3).filter((F.col(ROW_ID) >= begin) & (F.col(ROW_ID) % 10 != 0))
            rows = scaling.with_scaled(cleaning.accepted(cleaning.classify(trips)), scaler)
            rows = rows.filter(F.col(ROW_ID) % 3 == shard).select(*columns).collect()
            x = np.array([list(r) for r in rows])
            labels = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            counts = np.bincount(labels, minlength=3)
            sums = np.stack([x[labels == j].sum(axis=0) for j in range(3)])
            centers, held = minibatch.update_centers(centers, held, counts, sums)
        expected.append((centers, held))
    total = sum(h for _, h in expected)
    means = sum(c * h[:, None] for c, h in expected) / np.maximum(total, 1)[:, None]
    assert np.allclose(second[:2], means[:2]) and np.array_equal(weights, total)
    assert {r["step"] for r in spark.read.parquet(steps).collect()} == {1, 2}
