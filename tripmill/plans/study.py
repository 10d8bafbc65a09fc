"""Comparing the two algorithms over sizes and batch sizes on one frozen scaling.

A study does not fit its runs one after another: rows carry the number of the smallest nested prefix
they belong to, and every pass over the table serves all sizes, starts and batch sizes.  A run's
seconds are its part of the passes it took part in, by the rows it read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.functions.geometry import with_nearest
from tripmill.operators import kmeans, minibatch, quality
from tripmill.operators.sampling import prefix_cuts, sample_rows, with_priority
from tripmill.schema import ALGORITHMS, ALTERNATIVE_SEED, RESULTS_SCHEMA, ROW_ID, SEED
from tripmill.session import KEPT
from tripmill.sources.writers import union_records

# Sizes, batch sizes and the size the batch study runs on.
SIZES = (50_000, 100_000, 250_000, 500_000, 1_000_000)
BATCH_SIZES = (100, 500, 1_000, 5_000, 10_000)
BATCH_STUDY_ROWS = 100_000


@dataclass
class Measured:
    fit: kmeans.Fit
    seconds: float


# A fit among those of a study: algorithm, rows, rows of a batch, one pass or not.
RunKey = tuple[str, int, int, bool]


def nested(points: DataFrame, sizes: Sequence[int], total: int) -> DataFrame:
    """The points with the number of the smallest prefix that holds them, all prefixes cut in one search.

    Prefixes are the samples of ``sample_rows``; the last number stands for all rows.
    """
    smaller = [n for n in sizes if n < total]
    ranked = with_priority(points)
    outside = [(~cut).cast("int") for cut in prefix_cuts(ranked, smaller).values()] if smaller else []
    level = sum(outside, F.lit(0))
    return kmeans.spread_points(ranked.withColumn(kmeans.LEVEL, level).drop("priority"), total)


def shared_fits(
    leveled: DataFrame, columns: Sequence[str], k: int, runs: Sequence[RunKey], restarts: int
) -> dict[RunKey, Measured]:
    """All runs over a table of nested prefixes; sizes in order are its levels."""
    blocks = kmeans.packed(leveled, columns, ROW_ID, leveled=True).persist(KEPT)
    try:
        return _shared_fits(leveled, blocks, columns, k, runs, restarts)
    finally:
        blocks.unpersist()


def _shared_fits(leveled, blocks, columns, k, runs, restarts) -> dict[RunKey, Measured]:
    sizes = sorted({run[1] for run in runs})
    limits = {size: level for level, size in enumerate(sizes)}
    began = time.perf_counter()
    # Both algorithms start from the same draws.
    drawn = kmeans.drawn_starts(blocks, columns, ROW_ID, {n: (k, SEED, restarts) for n in sizes}, limits)
    starts = {n: kmeans.distinct_centers(found) for n, found in drawn.items()}
    drawing = time.perf_counter() - began
    fits: dict[RunKey, kmeans.Fit] = {}
    seconds: dict[RunKey, float] = {}

    def measured(part: Sequence[RunKey], spent: float) -> None:
        work = {run: run[1] * max(1, fits[run].passes or fits[run].iterations + 1) for run in part}
        for run in part:
            share = run[1] / sum(sizes)
            seconds[run] = drawing * share + spent * work[run] / sum(work.values())

    own = [run for run in runs if run[0] == "KMeans"]
    if own:
        began = time.perf_counter()
        found = kmeans.fit_many(
            blocks, {run: starts[run[1]] for run in own}, limits={run: limits[run[1]] for run in own}
        )
        fits.update(found)
        measured(own, time.perf_counter() - began)
    own = [run for run in runs if run[0] != "KMeans"]
    if own:
        began = time.perf_counter()
        batches = {
            run: minibatch.Run(
                run[1], minibatch.STREAM_BLOCK_ROWS if run[3] else run[2], 1 if run[3] else None, limits[run[1]]
            )
            for run in own
        }
        own_starts = {run: starts[run[1]] for run in own}
        fits.update(minibatch.fit_runs(leveled, columns, ROW_ID, batches, own_starts, blocks))
        measured(own, time.perf_counter() - began)
    return {run: Measured(fits[run], seconds[run]) for run in runs}


def _fit(points, columns, algorithm, k, rows, batch_rows, streaming, restarts) -> Measured:
    begin = time.perf_counter()
    if algorithm == "KMeans":
        fit = kmeans.fit_kmeans(points, columns, k, ROW_ID, SEED, restarts)
    elif streaming:
        fit = minibatch.fit_one_pass(points, columns, k, ROW_ID, rows)
    else:
        fit = minibatch.fit_minibatch(points, columns, k, ROW_ID, rows, batch_rows)
    return Measured(fit, time.perf_counter() - begin)


def _quality(metric: DataFrame, columns, centers: np.ndarray, other: np.ndarray | None):
    """Silhouette and agreement with the other model on the shared metric sample."""
    labeled = with_nearest(metric, columns, centers).drop("squared_distance")
    width = quality.silhouettes(labeled, columns, ["cluster"])["cluster"]
    if other is None:
        return width, None
    both = with_nearest(labeled.withColumnRenamed("cluster", "own"), columns, other)
    return width, quality.adjusted_rand(both, "own", "cluster").first()["ari"]


def compare(
    points: DataFrame,
    columns: Sequence[str],
    k: int,
    rows: int,
    runs: Sequence[tuple[str, int, bool]],
    environment: str = "local",
    experiment_id: str = "unrecorded",
    restarts: int = kmeans.RESTARTS,
    reference: np.ndarray | None = None,
    metric_sample: int = quality.SILHOUETTE_ROWS,
    keep: Callable[[DataFrame], None] | None = None,
    fitted: Mapping[RunKey, Measured] | None = None,
) -> DataFrame:
    """One result row per (algorithm, batch size, one-pass) run over the same points.

    ``fitted`` has the runs that were fitted before; others are fitted here.  ``reference`` are K-Means centers to compare with, otherwise those of a K-Means run before.
    A run that dies becomes a ``failed`` row.  ``keep`` is called with every row at once, so the
    rows before a lost driver are not lost with it.
    """
    spark = points.sparkSession
    names = RESULTS_SCHEMA.names
    metric = sample_rows(points, metric_sample, ALTERNATIVE_SEED)
    metric = metric.persist(StorageLevel.MEMORY_AND_DISK)
    metric_rows = metric.count()
    results = []

    def finish(row: dict) -> None:
        results.append(tuple(row.get(n) for n in names))
        if keep is not None:
            keep(spark.createDataFrame(results[-1:], RESULTS_SCHEMA))

    for algorithm, batch_rows, streaming in runs:
        begin = time.perf_counter()
        base = {
            "algorithm": algorithm,
            "rows": rows,
            "batch_size": batch_rows,
            "streaming": streaming,
            "seed": SEED,
            "k": k,
            "feature_count": len(columns),
            "environment": environment,
            "experiment_id": experiment_id,
        }
        try:
            run = (fitted or {}).get((algorithm, rows, batch_rows, streaming))
            if run is None:
                run = _fit(points, columns, algorithm, k, rows, batch_rows, streaming, restarts)
            width, agreement = _quality(metric, columns, run.fit.centers, reference)
        except Exception as error:  # whatever stopped it, the other runs go on
            finish({**base, "status": "failed", "detail": f"{type(error).__name__}: {error}"[:500]})
            continue
        if algorithm == "KMeans":
            reference = run.fit.centers
        finish(
            {
                **base,
                "status": "ok",
                "fit_seconds": run.seconds,
                "normalized_inertia": run.fit.normalized_inertia,
                "silhouette": width,
                "metric_rows": metric_rows,
                "ari_vs_kmeans": agreement,
                "cluster_sizes": run.fit.sizes,
                "iterations": run.fit.iterations,
                "worker_seconds": time.perf_counter() - begin + (run.seconds if fitted else 0.0),
                "detail": f"blocks of {minibatch.STREAM_BLOCK_ROWS} rows" if streaming else None,
            }
        )
    metric.unpersist()
    return spark.createDataFrame(results, RESULTS_SCHEMA)


def _together(
    points: DataFrame, columns: Sequence[str], k: int, runs: Sequence[RunKey], restarts: int
) -> dict[RunKey, Measured]:
    """The shared fits of a study; none if they fail, so that each run is tried alone."""
    try:
        return shared_fits(points, columns, k, runs, restarts)
    except Exception:  # the runs that can be fitted are found one by one
        return {}


def size_sweep(
    points: DataFrame,
    columns: Sequence[str],
    k: int,
    sizes: Sequence[int] = SIZES,
    full: bool = True,
    environment: str = "local",
    experiment_id: str = "unrecorded",
    restarts: int = kmeans.RESTARTS,
    keep: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Both algorithms on nested prefixes; sizes the data does not reach are reported, not run."""
    spark = points.sparkSession
    total = points.count()
    every = sorted({*sizes, *([total] if full else [])})
    runs = {n: [(name, minibatch.BATCH_ROWS, False) for name in ALGORITHMS] for n in every if n <= total}
    if full:
        runs[total].append(("MiniBatchKMeans", minibatch.BATCH_ROWS, True))
    leveled = nested(points, list(runs), total).persist(KEPT)
    keys = [(name, n, batch, streaming) for n, own in runs.items() for name, batch, streaming in own]
    fitted = _together(leveled, columns, k, keys, restarts) if keys else {}
    tables = []
    for size in every:
        if size > total:
            skipped = [
                (name, size, "skipped_insufficient_rows", environment, experiment_id)
                for name in ALGORITHMS
            ]
            table = spark.createDataFrame(
                skipped,
                "algorithm string, rows bigint, status string, environment string,"
                " experiment_id string",
            )
            tables.append(table)
            if keep is not None:
                keep(union_records([spark.createDataFrame([], RESULTS_SCHEMA), table]))
            continue
        prefix = leveled.filter(F.col(kmeans.LEVEL) <= list(runs).index(size)).drop(kmeans.LEVEL)
        tables.append(
            compare(
                prefix, columns, k, size, runs[size], environment, experiment_id, restarts,
                keep=keep, fitted=fitted,
            )
        )
    leveled.unpersist()
    return union_records([spark.createDataFrame([], RESULTS_SCHEMA), *tables])


def batch_study(
    points: DataFrame,
    columns: Sequence[str],
    k: int,
    batch_sizes: Sequence[int] = BATCH_SIZES,
    rows: int = BATCH_STUDY_ROWS,
    environment: str = "local",
    experiment_id: str = "unrecorded",
    restarts: int = kmeans.RESTARTS,
    keep: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Mini-batch fits of one prefix with different batch sizes, compared with its K-Means."""
    total = points.count()
    size = min(rows, total)
    leveled = nested(points, [size], total).filter(F.col(kmeans.LEVEL) == 0)
    leveled = leveled.persist(StorageLevel.MEMORY_AND_DISK)
    keys = [("KMeans", size, 0, False), *[("MiniBatchKMeans", size, batch, False) for batch in batch_sizes]]
    fitted = _together(leveled, columns, k, keys, restarts)
    prefix = leveled.drop(kmeans.LEVEL)
    best = fitted[keys[0]].fit if fitted else kmeans.fit_kmeans(prefix, columns, k, ROW_ID, SEED, restarts)
    runs = [("MiniBatchKMeans", batch, False) for batch in batch_sizes]
    table = compare(
        prefix, columns, k, size, runs, environment, experiment_id, restarts, best.centers,
        keep=keep, fitted=fitted,
    )
    leveled.unpersist()
    return table
