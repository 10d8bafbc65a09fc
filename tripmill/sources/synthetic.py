"""Seeded made-up trips for tests and demos; never a source of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.functions.priority import hash_priority, unit_interval
from tripmill.schema import DISTANCE, DROPOFF, FARE, PICKUP, REQUIRED, ROW_ID, SEED, TOTAL


def _uniform(low: float, high: float, seed: int, stream: int) -> Column:
    drawn = unit_interval(hash_priority(F.col("id"), seed * 1000 + stream))
    return F.lit(low) + drawn * (high - low)


def synthetic_trips(spark: SparkSession, n: int = 300, seed: int = SEED) -> DataFrame:
    """Each value depends on (row, seed) alone, so the partitioning never changes the data."""
    # Ranges of the made-up trips.
    drawn = spark.range(n).select(
        F.col("id").alias(ROW_ID),
        _uniform(0.3, 20.0, seed, 1).alias(DISTANCE),
        _uniform(2.0, 5.0, seed, 2).alias("pace"),
        F.floor(_uniform(0.0, 744.0, seed, 3)).alias("hours"),
        _uniform(3.0, 8.0, seed, 4).alias("surcharge"),
    )
    start = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.round((F.col(DISTANCE) * F.col("pace") + 2) * 60, 3)
    return (
        drawn.withColumn(PICKUP, start + F.make_dt_interval(hours=F.col("hours").cast("int")))
        .withColumn(DROPOFF, F.col(PICKUP) + F.make_dt_interval(secs=seconds))
        .withColumn(FARE, F.col(DISTANCE) * 3 + F.col("surcharge"))
        .withColumn(TOTAL, F.col(DISTANCE) * 3 + 12)
        .select(ROW_ID, *REQUIRED)
    )
