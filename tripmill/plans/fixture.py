"""Trips derived from the ``events`` table with exact arithmetic.

No trip file ships with the test data.  Every tenth-of-a-percent or so of the rows carries
one defect, so each rejection reason occurs; the rule is spelled out in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.schema import DISTANCE, DROPOFF, FARE, PICKUP, REQUIRED, ROW_ID, TOTAL
from tripmill.sources.readers import with_row_position


def _residue(modulus: int, rest: int) -> Column:
    return F.col("event_id") % modulus == rest


def trips_of_events(events: DataFrame) -> DataFrame:
    mixed = F.col("event_id") * 7919 + F.col("user_id") * 104729
    late = F.when(_residue(97, 5), 10800).otherwise(0)
    seconds = (30 + mixed % 5400 + late)
    value = F.col("value")
    fare = (
        F.when(_residue(103, 2), F.lit(float("nan")))
        .when(_residue(107, 4), F.lit(None).cast("double"))
        .when(_residue(83, 6), F.lit(-1.0))
        .otherwise(3 + 0.3 * value)
    )
    return events.select(
        F.col("event_id").alias(ROW_ID),
        F.col("ts").alias(PICKUP),
        F.when(~_residue(101, 1), F.col("ts") + F.make_dt_interval(secs=seconds)).alias(DROPOFF),
        F.when(_residue(89, 3), F.lit(0.0))
        .when(_residue(251, 7), F.lit(1e-100))
        .otherwise(value / 10)
        .alias(DISTANCE),
        fare.alias(FARE),
        F.when(_residue(109, 8), F.lit(2000.0)).otherwise(12 + 0.3 * value).alias(TOTAL),
    ).select(ROW_ID, *REQUIRED)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_of_events(read(spark, sf_dir, "events"))


def trips_of_lineitem(lines: DataFrame) -> DataFrame:
    """A larger trip table (six rows per event): quantities become miles, prices fares."""
    offset = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey"), F.lit(86400))
    seconds = 60 + F.pmod(
        F.col("l_partkey") * 104729 + F.col("l_suppkey") * 7919 + F.col("l_linenumber"),
        F.lit(7200),
    )
    pickup = F.col("l_shipdate") + F.make_dt_interval(secs=offset)
    fare = 3 + F.col("l_extendedprice") / 1000
    return lines.select(
        ROW_ID,
        pickup.alias(PICKUP),
        (pickup + F.make_dt_interval(secs=seconds)).alias(DROPOFF),
        (0.3 + F.col("l_quantity") * (1 + F.col("l_discount")) / 5).alias(DISTANCE),
        fare.alias(FARE),
        (fare * (1 + F.col("l_tax"))).alias(TOTAL),
    )


def line_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are numbered by their position in the file, as lines have no single key."""
    lines = with_row_position(read(spark, sf_dir, "lineitem"), "parquet")
    return trips_of_lineitem(lines)
