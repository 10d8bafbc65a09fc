"""Cluster quality: sizes, error, agreement between labelings, silhouette."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: silhouettes are measured on at most this many rows.
SILHOUETTE_ROWS = 2_000
# The sample is sent to every task, so its bytes are checked.
MAX_SAMPLE_BYTES = 64 * 1024**2
CHUNK_ROWS = 512


def cluster_sizes(labeled: DataFrame, k: int | str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per cluster; clusters without rows appear with size 0.

    ``k`` is the number of clusters, or the grouping column that holds it.
    """
    counted = labeled.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("size"))
    every = counted.select(*by).distinct() if by else labeled.sparkSession.range(1).select()
    last = (F.col(k) if isinstance(k, str) else F.lit(k)) - 1
    ids = F.explode(F.sequence(F.lit(0), last)).alias("cluster")
    return (
        every.select(*by, ids)
        .join(counted, [*by, "cluster"], "left")
        .withColumn("size", F.coalesce("size", F.lit(0)))
    )


def size_shares(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, smallest and largest share, and the sizes in cluster order."""
    # At most k entries per group are collected.
    ordered = F.sort_array(F.collect_list(F.struct("cluster", "size")))
    return sizes.groupBy(*by).agg(
        F.sum("size").alias("rows"),
        (F.min("size") / F.sum("size")).alias("min_cluster_share"),
        (F.max("size") / F.sum("size")).alias("max_cluster_share"),
        F.transform(ordered, lambda entry: entry["size"]).alias("cluster_sizes"),
    )


def normalized_inertia(labeled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labeled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("squared_distance").alias("normalized_inertia")
    )


def contingency(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, first, second).agg(F.count(F.lit(1)).alias("n"))


def _pairs(count: Column) -> Column:
    count = count.cast("double")
    return count * (count - 1) / 2


def adjusted_rand(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement of two labelings of the same rows, corrected for chance.

    Only the first aggregate sees the rows; everything after works on the contingency cells,
    rolled up to cell, row, column and total level in one grouping-sets aggregate.
    """
    cells = contingency(df, first, second, by).select(
        *by, F.col(first).alias("__a"), F.col(second).alias("__b"), "n"
    )
    keys = [F.col(name) for name in by]
    a, b = F.col("__a"), F.col("__b")
    sums = cells.groupingSets(
        [[*keys, a, b], [*keys, a], [*keys, b], keys], *keys, a, b
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("__level"))
    # The last two bits of the level say whether a and b are summed over.
    level = F.col("__level").bitwiseAND(3)
    total = lambda bits: F.sum(F.when(level == bits, _pairs(F.col("n"))))
    counted = sums.groupBy(*by).agg(
        F.max(F.when(level == 3, F.col("n"))).alias("rows"),
        total(0).alias("together"),
        total(1).alias("first_pairs"),
        total(2).alias("second_pairs"),
        total(3).alias("all_pairs"),
    )
    expected = F.col("first_pairs") * F.col("second_pairs") / F.col("all_pairs")
    most = (F.col("first_pairs") + F.col("second_pairs")) / 2
    index = F.when(
        (F.col("all_pairs") == 0) | (most == expected), F.lit(1.0)
    ).otherwise((F.col("together") - expected) / (most - expected))
    return counted.select(*by, "rows", index.alias("ari"))


class _Silhouettes:
    """Silhouette of each row of a batch against the whole (bounded) sample."""

    def __init__(self, points: np.ndarray, labels: np.ndarray):
        self.points, self.labels = points, labels

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = []
        for model in range(self.labels.shape[1]):
            names, codes = np.unique(self.labels[:, model], return_inverse=True)
            members.append((codes, np.eye(len(names))[codes]))
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for begin in range(0, len(rows), CHUNK_ROWS):
                yield from self._score(rows[begin : begin + CHUNK_ROWS], members)

    def _score(self, at: np.ndarray, members: list) -> Iterator[pa.RecordBatch]:
        squares = np.zeros((len(at), len(self.points)))
        for axis in self.points.T:
            squares += (axis[at, None] - axis) ** 2
        gaps = np.sqrt(squares)
        every = np.arange(len(at))
        for model, (codes, one_hot) in enumerate(members):
            if not 1 < one_hot.shape[1] < len(self.points):
                continue
            totals, sizes, own = gaps @ one_hot, one_hot.sum(axis=0), codes[at]
            alone = sizes[own] == 1
            inner = totals[every, own] / np.where(alone, 1, sizes[own] - 1)
            means = totals / sizes
            means[every, own] = np.inf
            outer = means.min(axis=1)
            largest = np.maximum(inner, outer)
            score = np.where(largest > 0, (outer - inner) / np.where(largest > 0, largest, 1), 0)
            columns = [
                pa.array(np.full(len(at), model), pa.int32()),
                pa.array(np.where(alone, 0.0, score), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["model", "score"])


def silhouettes(
    sample: DataFrame, columns: Sequence[str], labels: Sequence[str]
) -> dict[str, float | None]:
    """Mean Euclidean silhouette of several labelings of one bounded sample.

    The sample is at most a few thousand rows by definition.  Its rows are spread over the
    tasks and compared with a copy of the sample; no pair is ever materialized as a row.
    A labeling with one cluster, or one cluster per row, has no silhouette.
    """
    rows = sample.select(*columns, *labels).collect()
    width = len(columns)
    points = np.array(
        [np.concatenate([np.ravel(value) for value in row[:width]]) for row in rows], dtype="float64"
    )
    codes = np.array([list(row[width:]) for row in rows])
    if points.nbytes > MAX_SAMPLE_BYTES:
        raise ValueError(f"a silhouette sample of {points.nbytes} bytes is too large; sample less")
    spark = sample.sparkSession
    tasks = max(1, min(len(rows) // 250, spark.sparkContext.defaultParallelism))
    each = spark.range(0, len(rows), 1, tasks).mapInArrow(
        _Silhouettes(points, codes), "model int, score double"
    )
    means = {
        row["model"]: row["mean"]
        for row in each.groupBy("model").agg(F.avg("score").alias("mean")).collect()
    }
    return {name: means.get(i) for i, name in enumerate(labels)}


def silhouette_squared(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Mean silhouette of all rows under squared Euclidean distance: ``rows``, ``silhouette``.

    The mean squared distance to a cluster follows from its size, its coordinate sums and its sum of
    squares, so one aggregate per cluster and one pass over the rows replace all pairs.  The
    clusters (k rows) travel as literals.  Rows of one-row clusters count 0; with fewer than two
    clusters the silhouette is null.
    """
    length = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    stats = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(length).alias("q"), *[F.sum(c).alias(c) for c in columns]
    )
    clusters = sorted(tuple(row) for row in stats.collect())
    if len(clusters) < 2:
        return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("silhouette"))

    def mean_gap(size: int, squares: float, sums: Sequence[float]):
        cross = sum((F.col(c) * float(s) for c, s in zip(columns, sums)), F.lit(0.0))
        return length + F.lit(squares / size) - 2 * cross / size

    inner, outer = F.lit(None).cast("double"), []
    for name, size, squares, *sums in clusters:
        gap = mean_gap(size, squares, sums)
        here = F.col(label) == name
        inner = F.when(here, gap * size / (size - 1) if size > 1 else F.lit(None)).otherwise(inner)
        outer.append(F.when(~here, gap))
    nearest = F.least(*outer)
    # Rounding can leave a tiny negative distance between equal points.
    a, b = F.greatest(inner, F.lit(0.0)), F.greatest(nearest, F.lit(0.0))
    largest = F.greatest(a, b)
    score = F.when(inner.isNull() | (largest == 0), 0.0).otherwise((b - a) / largest)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("silhouette"))
