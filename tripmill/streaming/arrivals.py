"""The same operators on files as they arrive.

Validation and scoring are stateless, so a stream gives exactly the batch result.  The
incremental fit is a stateful stream: rows are dealt to shards, and the state of a shard is its centers
and their weights, moved once for each batch that arrives.  The checkpoint holds what was read and the
states of each batch together, so a batch that is run again, and a start without new files, change
nothing.  A center is a weighted mean of rows, so the shards' centers join by their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tripmill.functions.geometry import nearest_of
from tripmill.operators import bundle as bundles
from tripmill.operators.cleaning import accepted, classify, with_outcome
from tripmill.operators.minibatch import update_centers
from tripmill.operators.scaling import Scaler, scaled_names, with_scaled
from tripmill.schema import ROW_ID, Rules
from tripmill.sources.readers import with_row_position

# Shards move side by side; their number is part of the model, not of the cluster it runs on.
SHARDS = 16
# What a batch leaves in the table of the fit: k rows for each shard that had rows.
STEPS_SCHEMA = "shard int, step bigint, cluster int, center array<double>, weight double"
STATE_SCHEMA = "step bigint, centers array<double>, weights array<double>"


def read_arrivals(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files_per_batch: int = 1,
    name_filter: str | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; positions count within each file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def positioned(stream: DataFrame) -> DataFrame:
    """``row_id`` is the position in the file, ``arrival`` identifies the file."""
    arrival = F.md5(F.col("_metadata.file_path"))
    return with_row_position(stream.withColumn("arrival", arrival), "parquet")


def run_available(stream: DataFrame, out: str, checkpoint: str, partition_by: tuple = ()) -> None:
    """Process what has arrived into a Parquet table, then stop; a rerun continues."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    query = (writer.partitionBy(*partition_by) if partition_by else writer).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def validate_arrivals(
    trips: DataFrame, out: str, checkpoint: str, rules: Rules = Rules(), keep: tuple = ()
) -> None:
    """Accepted and rejected rows as partitions of one table: one read of each file."""
    checked = with_outcome(classify(trips, rules, keep))
    run_available(checked, out, checkpoint, ("outcome",))


def score_arrivals(
    trips: DataFrame,
    bundle: bundles.Bundle,
    algorithm: str,
    out: str,
    checkpoint: str,
    keep: tuple = (),
) -> None:
    good = accepted(classify(trips, bundle.rules, keep))
    scored = bundles.assign(good, bundle, algorithm).drop(*bundle.columns)
    run_available(scored, out, checkpoint)


def fit_arrivals(
    trips: DataFrame,
    scaler: Scaler,
    start: np.ndarray,
    out: str,
    checkpoint: str,
    rules: Rules = Rules(),
    shard: Column | None = None,
) -> None:
    """Move the centers by the accepted rows of every batch; ``out`` gets each step of each shard.

    Rows of a batch are assigned with the shard's centers at its beginning, and each center becomes
    the mean of all rows it was ever given.  Rows are read chunk by chunk and only summed up.
    """
    begin = np.asarray(start, dtype="float64")
    names = scaled_names(scaler.features)
    own = F.pmod(F.xxhash64(ROW_ID), F.lit(SHARDS)) if shard is None else shard
    good = with_scaled(accepted(classify(trips, rules)), scaler)
    points = good.select(own.cast("int").alias("shard"), *names)

    def moved(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, centers, weights = 0, begin, np.zeros(len(begin))
        if state.exists:
            step, flat, held = state.get
            centers, weights = np.array(flat).reshape(begin.shape), np.array(held)
        counts, sums = np.zeros(len(begin)), np.zeros(begin.shape)
        for chunk in chunks:
            x = chunk[names].to_numpy(dtype="float64")
            labels, _ = nearest_of(x, centers)
            counts += np.bincount(labels, minlength=len(begin))
            np.add.at(sums, labels, x)
        centers, weights = update_centers(centers, weights, counts, sums)
        state.update((step + 1, centers.ravel().tolist(), weights.tolist()))
        yield pd.DataFrame(
            {
                "shard": key[0],
                "step": step + 1,
                "cluster": range(len(begin)),
                "center": centers.tolist(),
                "weight": weights,
            }
        )

    steps = points.groupBy("shard").applyInPandasWithState(
        moved, STEPS_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
    run_available(steps, out, checkpoint)


def joined_model(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, steps, weight, center``: the last step of every shard, joined by weight.

    A center without rows in any shard is where it began.
    """
    rows = spark.read.schema(STEPS_SCHEMA).parquet(path)
    last = rows.groupBy("shard", "cluster").agg(
        F.max("step").alias("steps"), F.max_by(F.struct("center", "weight"), "step").alias("last")
    )
    axes = last.select("cluster", "steps", "last.weight", F.posexplode("last.center").alias("axis", "value"))
    joined = axes.groupBy("cluster", "axis").agg(
        F.max("steps").alias("steps"),
        F.sum("weight").alias("weight"),
        (F.sum(F.col("weight") * F.col("value")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean"),
        F.first("value").alias("begun"),
    )
    placed = F.struct("axis", F.coalesce("mean", "begun").alias("value"))
    return joined.groupBy("cluster").agg(
        F.max("steps").alias("steps"),
        F.max("weight").alias("weight"),
        F.transform(F.array_sort(F.collect_list(placed)), lambda a: a["value"]).alias("center"),
    )


def current_centers(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Centers and weights of the joined model: k rows."""
    rows = sorted(joined_model(spark, path).collect(), key=lambda row: row["cluster"])
    return np.array([row["center"] for row in rows]), np.array([row["weight"] for row in rows])
