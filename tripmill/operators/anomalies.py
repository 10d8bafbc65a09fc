"""Distance outliers: thresholds, flags, severity views and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.operators.quantiles import EXACT_ROWS, quantiles

# Percentile, smallest divisor and the severity steps of the explorer.
PERCENTILE = 99.0
SMALLEST_THRESHOLD = 1e-12
SEVERITIES = (1, 2, 5)
HISTOGRAM_BINS = 50


def check_percentile(percentile: float) -> float:
    if not 0 < percentile < 100:
        raise ValueError(f"the anomaly percentile must lie between 0 and 100, got {percentile}")
    return float(percentile)


def with_distance(labeled: DataFrame) -> DataFrame:
    return labeled.withColumn("centroid_distance", F.sqrt("squared_distance")).drop(
        "squared_distance"
    )


def distance_threshold(
    scored: DataFrame, percentile: float = PERCENTILE, exact_rows: int = EXACT_ROWS
) -> float:
    share = check_percentile(percentile) / 100
    return quantiles(scored, {"centroid_distance": [share]}, exact_rows)["centroid_distance", share]


def with_flags(scored: DataFrame, threshold: float) -> DataFrame:
    distance = F.col("centroid_distance")
    return scored.withColumn(
        "anomaly_ratio", distance / F.lit(max(threshold, SMALLEST_THRESHOLD))
    ).withColumn("distance_outlier", distance > F.lit(threshold))


def outliers(flagged: DataFrame) -> DataFrame:
    return flagged.filter("distance_outlier")


def outlier_summary(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return flagged.groupBy(*by).agg(
        F.count_if("distance_outlier").alias("outliers"),
        F.count(F.lit(1)).alias("population_rows"),
        (F.count_if("distance_outlier") / F.count(F.lit(1))).alias("outlier_rate"),
    )


def severity_rows(flagged: DataFrame, ratio: float = 1, cluster: int | None = None) -> DataFrame:
    """Rows strictly above a multiple of the threshold, optionally of one cluster."""
    rows = flagged.filter(F.col("anomaly_ratio") > ratio)
    return rows if cluster is None else rows.filter(F.col("cluster") == cluster)


def severity_counts(flagged: DataFrame, ratios: Sequence[float] = SEVERITIES) -> DataFrame:
    """Rows per cluster above each ratio, counted in one pass."""
    return flagged.groupBy("cluster").agg(
        *[F.count_if(F.col("anomaly_ratio") > ratio).alias(f"above_{ratio:g}x") for ratio in ratios]
    )


def strongest(flagged: DataFrame, rows: int = 5, key: str = "row_id") -> DataFrame:
    return flagged.orderBy(F.desc("anomaly_ratio"), key).limit(rows)


def outlier_evidence(flagged: DataFrame, exact_rows: int = EXACT_ROWS) -> dict[str, float | None]:
    """Largest ratio and the medians of the outliers of one model."""
    rows = outliers(flagged)
    medians = quantiles(
        rows,
        {name: [0.5] for name in ("anomaly_ratio", "trip_distance", "fare_per_mile")},
        exact_rows,
    )
    return {
        "max_ratio": rows.agg(F.max("anomaly_ratio")).first()[0],
        "median_ratio": medians["anomaly_ratio", 0.5],
        "median_distance": medians["trip_distance", 0.5],
        "median_fare_per_mile": medians["fare_per_mile", 0.5],
    }


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value; the last bin is closed."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, rows bigint")
    width = (high - low) / bins or 1.0
    place = F.floor((F.col(column) - F.lit(low)) / F.lit(width))
    counted = df.select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
    counted = counted.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), "rows")
