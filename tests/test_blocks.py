"""Points packed into blocks, and passes that read only what their models see."""

import numpy as np
from pyspark.sql import functions as F

from tripmill.operators import kmeans, minibatch
from tripmill.plans import study
from tripmill.schema import ROW_ID

AXES = ["x", "y"]


def leveled_points(spark):
    return spark.range(0, 30_000, 1, 3).select(
        F.col("id").alias(ROW_ID),
        F.when(F.col("id") % 100 == 0, 0).otherwise(1).alias(kmeans.LEVEL),
        (F.col("id") % 97 / 9).alias("x"),
        (F.col("id") % 89 / 7).alias("y"),
    )


def test_packed_points_give_the_sums_of_their_rows(spark):
    points = leveled_points(spark)
    blocks = kmeans.packed(points, AXES, ROW_ID, leveled=True).persist()
    # A pass hands on a few blocks instead of every row.
    assert blocks.count() <= 12
    centers = {0: np.array([[1.0, 2.0], [8.0, 3.0]]), 7: np.array([[0.0, 0.0], [5.0, 5.0], [9.0, 9.0]])}
    limits = {0: 0, 7: 1}
    plain = kmeans.cluster_sums(points.select(kmeans.LEVEL, *AXES), centers, 3, 0, limits)
    found = kmeans.cluster_sums(blocks, centers, 3, 0, limits)
    assert found[0][0].sum() == 300 and found[7][0].sum() == 30_000
    for number in centers:
        for left, right in zip(plain[number], found[number]):
            assert np.allclose(left, right)
    blocks.unpersist()


def test_a_small_prefix_is_fitted_without_the_blocks_of_the_rest(spark):
    """The blocks of other levels would break the task if it read them."""
    blocks = kmeans.packed(leveled_points(spark), AXES, ROW_ID, leveled=True)
    broken = F.when(F.col(kmeans.LEVEL) == 1, F.lit(b"no numbers")).otherwise(F.col("points"))
    torn = blocks.select(kmeans.LEVEL, "keys", broken.alias("points"))
    fit = kmeans.fit_many(torn, {"small": [np.array([[1.0, 2.0], [8.0, 3.0]])]}, limits={"small": 0})["small"]
    assert fit.rows == 300


def test_packed_batches_have_every_row_once(spark):
    points = leveled_points(spark).select(F.lit(0).alias(kmeans.LEVEL), F.xxhash64(ROW_ID).bitwiseAND(2**52 - 1).alias("priority"), *AXES)
    tables = minibatch.dealt(points, [minibatch.Run(30_000, 700)], pack=True)
    sums, sizes = np.zeros(2), []
    for place, (table, _) in enumerate(tables):
        for row in table.where("whole").collect():
            x = np.frombuffer(row["points"]).reshape(-1, 2)
            sums += x.sum(axis=0)
            sizes.append(len(x))
            assert place == len(tables) - 1 or len(x) % 700 == 0
        table.unpersist()
    assert sum(sizes) == 30_000 and len(sizes) < 100
    assert np.allclose(sums, points.agg(F.sum("x"), F.sum("y")).first())


def test_rounds_of_long_chains_have_tables_of_their_own(spark, monkeypatch):
    """A task holds a bounded part of a chain, and the same batches come in the same order."""
    points = leveled_points(spark).select(F.lit(0).alias(kmeans.LEVEL), F.xxhash64(ROW_ID).bitwiseAND(2**52 - 1).alias("priority"), ROW_ID, *AXES)

    def dealt(task_rows):
        monkeypatch.setattr(minibatch, "TASK_ROWS", task_rows, raising=False)
        cells, largest, turn = [], 0, 0
        for table, rounds in minibatch.dealt(points, [minibatch.Run(30_000, 100)]):
            for row in table.where("whole").groupBy("chain", "round").agg(F.collect_list(ROW_ID).alias("ids")).collect():
                cells.append((turn + row["round"], row["chain"], row["ids"]))
            largest = max(largest, max(r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()))
            turn += rounds
            table.unpersist()
        return sorted(cells), largest

    bounded, most = dealt(1_000)
    together, all_rounds = dealt(1_000_000)
    # 32 cells of about 940 rows, one in a task, and 1,600 rows left; or the four rounds of a chain.
    assert most < 2_000 < 3_000 < all_rounds
    assert bounded == together


def test_fits_do_not_depend_on_the_tables_of_their_rounds(spark, monkeypatch):
    points = leveled_points(spark).drop(kmeans.LEVEL)
    starts = {"all": [np.array([[1.0, 2.0], [8.0, 3.0]]), np.array([[5.0, 12.0], [9.0, 1.0]])]}
    fits = []
    for task_rows in (1_000, 2_500, 1_000_000):
        monkeypatch.setattr(minibatch, "TASK_ROWS", task_rows, raising=False)
        fits.append(minibatch.fit_runs(points, AXES, ROW_ID, {"all": minibatch.Run(30_000, 100, 2)}, starts)["all"])
    assert all(np.allclose(fit.centers, fits[0].centers) and fit.sizes == fits[0].sizes for fit in fits)
    assert all(fit.iterations == 600 and fit.update_rows == 100 for fit in fits)


def test_growing_tables_leave_the_heap_to_the_tasks(spark, monkeypatch):
    """Blocks and dealt batches are read many times and as large as the input: none of them is kept in memory."""
    levels = []
    persist = type(spark.range(0)).persist
    monkeypatch.setattr(type(spark.range(0)), "persist", lambda self, *level: levels.append(level) or persist(self, *level))
    points = leveled_points(spark).drop(kmeans.LEVEL)
    kmeans.fit_kmeans(points, AXES, 2, ROW_ID, restarts=1, max_iterations=1)
    minibatch.fit_minibatch(points, AXES, 2, ROW_ID, 30_000, restarts=1, passes=1)
    assert len(levels) >= 3 and not any(level.useMemory for level, in levels)


def test_a_sweep_keeps_its_points_on_disk(spark, monkeypatch):
    kept = []
    persist = type(spark.range(0)).persist
    monkeypatch.setattr(
        type(spark.range(0)), "persist", lambda self, *level: kept.append((self.columns, *level)) or persist(self, *level)
    )
    points = leveled_points(spark).drop(kmeans.LEVEL)
    table = study.size_sweep(points, AXES, 2, sizes=(500, 90_000), restarts=1)
    assert {r["status"] for r in table.collect()} == {"ok", "skipped_insufficient_rows"}
    # The nested prefixes and their blocks; the metric sample is bounded.
    leveled = [level for columns, level in kept if kmeans.LEVEL in columns]
    assert len(leveled) == 2 and not any(level.useMemory for level in leveled)
