"""Names, thresholds and table layouts shared by every module."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

# The input contract, the model features and the rejection reasons.
PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
DISTANCE = "trip_distance"
FARE = "fare_amount"
TOTAL = "total_amount"
TIME_COLUMNS = (PICKUP, DROPOFF)
AMOUNT_COLUMNS = (DISTANCE, FARE, TOTAL)
REQUIRED = TIME_COLUMNS + AMOUNT_COLUMNS
FEATURES = (
    "trip_distance",
    "duration_minutes",
    "speed_mph",
    "fare_per_mile",
    "hour_sin",
    "hour_cos",
)
PROFILE_COLUMNS = FEATURES + ("pickup_hour", "fare_amount")
REASONS = (
    "invalid_timestamp",
    "missing_or_nonfinite_amount_distance",
    "duration_out_of_range",
    "distance_out_of_range",
    "charge_out_of_range",
    "speed_out_of_range",
    "nonfinite_features",
)
ALGORITHMS = ("KMeans", "MiniBatchKMeans")
STATUSES = (
    "ok",
    "failed",
    "skipped_memory_preflight",
    "skipped_insufficient_rows",
    "aborted_timeout",
    "aborted_low_memory",
)
SEED = 42
ALTERNATIVE_SEED = 43
ROW_ID = "row_id"
REASON = "rejection_reason"


@dataclass(frozen=True)
class Rules:
    """Acceptance limits; each becomes a literal in the classifier expression."""

    # Default limits.
    min_minutes: float = 1
    max_minutes: float = 180
    max_distance: float = 150
    max_speed: float = 100
    max_fare: float = 1000
    max_total: float = 1500

    def as_dict(self) -> dict[str, float]:
        return {name: float(value) for name, value in asdict(self).items()}


def check_features(features: Sequence[str]) -> tuple[str, ...]:
    """A model may use any nonempty, duplicate-free subset of FEATURES, in any order."""
    chosen = tuple(features)
    unknown = [name for name in chosen if name not in FEATURES]
    if not chosen or unknown or len(set(chosen)) < len(chosen):
        raise ValueError(f"features must be distinct names out of {FEATURES}, got {chosen}")
    return chosen


SCORES_SCHEMA = T.StructType(
    [
        T.StructField("k", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("normalized_inertia", T.DoubleType()),
        T.StructField("silhouette", T.DoubleType()),
        T.StructField("stability_ari", T.DoubleType()),
        T.StructField("min_cluster_share", T.DoubleType()),
        T.StructField("max_cluster_share", T.DoubleType()),
        T.StructField("cluster_sizes", T.ArrayType(T.LongType())),
    ]
)

RESULTS_SCHEMA = T.StructType(
    [
        T.StructField("algorithm", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("streaming", T.BooleanType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("feature_count", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("fit_seconds", T.DoubleType()),
        T.StructField("normalized_inertia", T.DoubleType()),
        T.StructField("silhouette", T.DoubleType()),
        T.StructField("metric_rows", T.LongType()),
        T.StructField("ari_vs_kmeans", T.DoubleType()),
        T.StructField("cluster_sizes", T.ArrayType(T.LongType())),
        T.StructField("iterations", T.IntegerType()),
        T.StructField("worker_seconds", T.DoubleType()),
        T.StructField("environment", T.StringType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)
