"""Standardization: fitted once, frozen, and applied as literal expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.schema import check_features


@dataclass(frozen=True)
class Scaler:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    variance: tuple[float, ...]
    samples_seen: int

    def __post_init__(self) -> None:
        width = len(self.features)
        for label in ("mean", "scale", "variance"):
            values = getattr(self, label)
            if len(values) != width or not all(math.isfinite(v) for v in values):
                raise ValueError(f"scaler {label} must hold {width} finite numbers")
        if min(self.scale) <= 0 or min(self.variance) < 0:
            raise ValueError("scaler scale must be positive and variance nonnegative")


SCALER_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("variance", T.DoubleType()),
        T.StructField("samples_seen", T.LongType()),
    ]
)


def scaler_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: mean, population variance, scale (1 where constant), rows."""
    # One aggregate over the columns, unpivoted afterwards: the input is read once.
    wide = df.agg(
        F.count(F.lit(1)).alias("samples_seen"),
        *[F.avg(name).alias(f"mean_{i}") for i, name in enumerate(features)],
        *[F.var_pop(name).alias(f"variance_{i}") for i, name in enumerate(features)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("feature"),
                F.col(f"mean_{i}").alias("mean"),
                F.col(f"variance_{i}").alias("variance"),
            )
            for i, name in enumerate(features)
        ]
    )
    root = F.sqrt("variance")
    return (
        wide.select("samples_seen", F.inline(rows))
        .withColumn("scale", F.when(root > 0, root).otherwise(F.lit(1.0)))
        .select(*SCALER_SCHEMA.names)
    )


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    return scaler_from_table(scaler_statistics(df, features))


def scaler_from_table(table: DataFrame) -> Scaler:
    rows = sorted(table.collect(), key=lambda row: row["position"])
    return Scaler(
        tuple(row["feature"] for row in rows),
        tuple(row["mean"] for row in rows),
        tuple(row["scale"] for row in rows),
        tuple(row["variance"] for row in rows),
        int(rows[0]["samples_seen"]),
    )


def scaler_table(spark: SparkSession, scaler: Scaler) -> DataFrame:
    rows = [
        (i, name, scaler.mean[i], scaler.scale[i], scaler.variance[i], scaler.samples_seen)
        for i, name in enumerate(scaler.features)
    ]
    return spark.createDataFrame(rows, SCALER_SCHEMA)


def scaled_name(feature: str) -> str:
    return f"z_{feature}"


def scaled_names(features: Sequence[str]) -> list[str]:
    return [scaled_name(name) for name in features]


def scaled_columns(scaler: Scaler) -> dict[str, Column]:
    return {
        scaled_name(name): (F.col(name) - F.lit(scaler.mean[i])) / F.lit(scaler.scale[i])
        for i, name in enumerate(scaler.features)
    }


def with_scaled(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns(scaled_columns(scaler))


def unscale_centers(scaler: Scaler, centers: np.ndarray) -> np.ndarray:
    return np.asarray(centers) * np.asarray(scaler.scale) + np.asarray(scaler.mean)


def centers_in_units(centers: DataFrame, scaler: DataFrame) -> DataFrame:
    """Long centroid table (.., position, value) back in the units of each feature."""
    return centers.join(F.broadcast(scaler), "position").withColumn(
        "original", F.col("value") * F.col("scale") + F.col("mean")
    )


SNAPSHOT_VERSION = 1


def snapshot(
    scaler: Scaler, k: int, rules: dict, seed: int, source_sha256: str, cleaned_rows: int
) -> dict:
    """Everything a later run needs to reuse this preprocessing, as plain JSON values."""
    return {
        "version": SNAPSHOT_VERSION,
        "features": list(scaler.features),
        "k": k,
        "rules": dict(rules),
        "seed": seed,
        "scaler": {
            "mean": list(scaler.mean),
            "scale": list(scaler.scale),
            "variance": list(scaler.variance),
            "samples_seen": scaler.samples_seen,
        },
        "source_sha256": source_sha256,
        "cleaned_rows": cleaned_rows,
    }


def restore_scaler(saved: dict) -> Scaler:
    state = saved["scaler"]
    return Scaler(
        check_features(saved["features"]),
        tuple(float(v) for v in state["mean"]),
        tuple(float(v) for v in state["scale"]),
        tuple(float(v) for v in state["variance"]),
        int(state["samples_seen"]),
    )


def reconcile(provenance: dict, saved: dict) -> None:
    """A source may only be combined with a frozen run on the same bytes and row count."""
    pairs = (("sha256", "source_sha256"), ("accepted_rows", "cleaned_rows"))
    wrong = [theirs for ours, theirs in pairs if provenance[ours] != saved[theirs]]
    if saved["version"] != SNAPSHOT_VERSION:
        wrong.append("version")
    if wrong:
        raise ValueError(f"the source differs from the frozen run in: {', '.join(wrong)}")
