"""Fitted models: one frozen scaler, one centroid table per algorithm, thresholds and axes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.functions.geometry import with_nearest
from tripmill.operators import anomalies, kmeans, minibatch, projection
from tripmill.operators.cleaning import validate
from tripmill.operators.profiles import cluster_profiles
from tripmill.operators.sampling import sample_rows
from tripmill.operators.scaling import SCALER_SCHEMA, Scaler, fit_scaler, scaled_names
from tripmill.operators.scaling import scaler_from_table, scaler_table, unscale_centers, with_scaled
from tripmill.schema import FEATURES, ROW_ID, SEED, Rules, check_features
from tripmill.sources.writers import load_document, save_csv, save_document, save_parquet

BUNDLE_VERSION = 1
CENTROID_SCHEMA = T.StructType(
    [
        T.StructField("algorithm", T.StringType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("center", T.ArrayType(T.DoubleType())),
        T.StructField("threshold", T.DoubleType()),
    ]
)
AXES_SCHEMA = T.StructType(
    [
        T.StructField("dimensions", T.IntegerType()),
        T.StructField("axis", T.IntegerType()),
        T.StructField("loadings", T.ArrayType(T.DoubleType())),
    ]
)


@dataclass
class Bundle:
    features: tuple[str, ...]
    rules: Rules
    scaler: Scaler
    models: dict[str, np.ndarray]
    thresholds: dict[str, float]
    axes: dict[int, np.ndarray] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return scaled_names(self.features)

    def centers(self, algorithm: str) -> np.ndarray:
        if algorithm not in self.models:
            raise ValueError(f"no model {algorithm}; saved models: {sorted(self.models)}")
        return self.models[algorithm]


def assign(df: DataFrame, bundle: Bundle, algorithm: str) -> DataFrame:
    """Scaled columns, cluster, distance, ratio and flag: projections only, no shuffle."""
    labeled = with_nearest(with_scaled(df, bundle.scaler), bundle.columns, bundle.centers(algorithm))
    return anomalies.with_flags(anomalies.with_distance(labeled), bundle.thresholds[algorithm])


def predict(
    bundle: Bundle, df: DataFrame, algorithm: str, chart_rows: int = projection.CHART_ROWS
) -> tuple[DataFrame, DataFrame, dict]:
    """Validate and score new rows with the saved model; nothing is fitted.

    Every accepted row is scored.  Only ``chart_rows`` of them get view coordinates.
    """
    bundle.centers(algorithm)
    good, bad, report = validate(df, bundle.rules)
    return score(bundle, good, algorithm, chart_rows), bad, report


def score(
    bundle: Bundle, good: DataFrame, algorithm: str, chart_rows: int = projection.CHART_ROWS
) -> DataFrame:
    """Score rows that were accepted before."""
    scored = assign(good, bundle, algorithm)
    placed = projection.attach_coordinates(scored, bundle.columns, bundle.axes, chart_rows)
    return placed.drop(*bundle.columns)


def centroid_units(spark: SparkSession, bundle: Bundle, algorithm: str) -> DataFrame:
    """Centroids in the units of the features."""
    original = unscale_centers(bundle.scaler, bundle.centers(algorithm))
    rows = [(i, *[float(v) for v in center]) for i, center in enumerate(original)]
    schema = "cluster int, " + ", ".join(f"{name} double" for name in bundle.features)
    return spark.createDataFrame(rows, schema)


def fit_bundle(
    df: DataFrame,
    k: int = 4,
    rules: Rules = Rules(),
    features: Sequence[str] = FEATURES,
    percentile: float = anomalies.PERCENTILE,
    restarts: int = kmeans.RESTARTS,
    with_projection: bool = True,
    source: str = "synthetic",
) -> Bundle:
    """Fit both algorithms on the accepted rows of one table."""
    features = check_features(features)
    anomalies.check_percentile(percentile)
    good, _, report = validate(df, rules)
    rows = report["accepted_rows"]
    if rows < max(3 * k, 15):
        raise ValueError(f"{rows} accepted rows are too few for {k} clusters")
    scaler = fit_scaler(good, features)
    columns = scaled_names(features)
    points = kmeans.spread_points(with_scaled(good, scaler).select(ROW_ID, *columns), rows)
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    fits = {
        "KMeans": kmeans.fit_kmeans(points, columns, k, ROW_ID, SEED, restarts),
        "MiniBatchKMeans": minibatch.fit_minibatch(points, columns, k, ROW_ID, rows),
    }
    thresholds = {}
    for name, fit in fits.items():
        labeled = with_nearest(points.select(*columns), columns, fit.centers)
        thresholds[name] = anomalies.distance_threshold(
            anomalies.with_distance(labeled), percentile
        )
    axes = projection.fit_axes(points, columns) if with_projection else {}
    points.unpersist()
    metadata = {
        "source": source,
        "seed": SEED,
        "k": k,
        "restarts": restarts,
        "features": list(features),
        "training": report,
        "projection_rows": min(projection.FIT_ROWS, rows),
        "anomaly_percentile": percentile,
        "rules": rules.as_dict(),
        "iterations": {name: fit.iterations for name, fit in fits.items()},
        "normalized_inertia": {name: fit.normalized_inertia for name, fit in fits.items()},
    }
    centers = {name: fit.centers for name, fit in fits.items()}
    return Bundle(features, rules, scaler, centers, thresholds, axes, metadata)


def training_profiles(bundle: Bundle, good: DataFrame) -> DataFrame:
    """Profiles of every model, stacked."""
    tables = [
        cluster_profiles(assign(good, bundle, name)).withColumn("algorithm", F.lit(name))
        for name in bundle.models
    ]
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table)
    return stacked


def summarize_training(bundle: Bundle, good: DataFrame, out: str) -> dict:
    """Write the flagged rows and centroids of every model; return the anomaly report."""
    spark = good.sparkSession
    population = bundle.metadata["training"]["accepted_rows"]
    report = {}
    for name in bundle.models:
        flagged = anomalies.outliers(assign(good, bundle, name)).drop(*bundle.columns)
        save_parquet(flagged, f"{out}/anomalies_{name}.parquet")
        report[name] = {
            "count": spark.read.parquet(f"{out}/anomalies_{name}.parquet").count(),
            "population_rows": population,
            "threshold": bundle.thresholds[name],
        }
        save_csv(centroid_units(spark, bundle, name).coalesce(1), f"{out}/centroids_{name}.csv")
    return report


def save_bundle(spark: SparkSession, bundle: Bundle, out: str) -> None:
    """Models as open tables instead of pickles."""
    save_parquet(scaler_table(spark, bundle.scaler), f"{out}/scaler.parquet")
    centers = [
        (name, i, [float(v) for v in center], bundle.thresholds[name])
        for name, model in bundle.models.items()
        for i, center in enumerate(model)
    ]
    save_parquet(spark.createDataFrame(centers, CENTROID_SCHEMA), f"{out}/centroids.parquet")
    axes = [
        (d, axis, [float(v) for v in loadings[:, axis]])
        for d, loadings in bundle.axes.items()
        for axis in range(d)
    ]
    save_parquet(spark.createDataFrame(axes, AXES_SCHEMA), f"{out}/axes.parquet")
    header = {
        "version": BUNDLE_VERSION,
        "features": list(bundle.features),
        "rules": bundle.rules.as_dict(),
        "metadata": bundle.metadata,
    }
    save_document(spark, header, f"{out}/bundle.json")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    try:
        header = load_document(spark, f"{path}/bundle.json")
    except AnalysisException as error:
        raise ValueError(f"no saved models in {path}") from error
    scaler = scaler_from_table(spark.read.schema(SCALER_SCHEMA).parquet(f"{path}/scaler.parquet"))
    features = check_features(header["features"])
    models: dict[str, dict] = {}
    thresholds = {}
    for row in spark.read.schema(CENTROID_SCHEMA).parquet(f"{path}/centroids.parquet").collect():
        models.setdefault(row["algorithm"], {})[row["cluster"]] = row["center"]
        thresholds[row["algorithm"]] = row["threshold"]
    axes: dict[int, dict] = {}
    for row in spark.read.schema(AXES_SCHEMA).parquet(f"{path}/axes.parquet").collect():
        axes.setdefault(row["dimensions"], {})[row["axis"]] = row["loadings"]
    centers = {name: np.array([c[i] for i in sorted(c)]) for name, c in models.items()}
    widths = {model.shape[1] for model in centers.values()}
    if (
        header["version"] != BUNDLE_VERSION
        or scaler.features != features
        or widths != {len(features)}
    ):
        raise ValueError("the saved models do not fit this version; train them again")
    return Bundle(
        features,
        Rules(**header["rules"]),
        scaler,
        centers,
        thresholds,
        {d: np.array([views[i] for i in sorted(views)]).T for d, views in axes.items()},
        header["metadata"],
    )


def reference_sample(
    bundle: Bundle, good: DataFrame, algorithm: str, rows: int = projection.FIT_ROWS
) -> DataFrame:
    """A bounded, scored sample of the training rows with coordinates."""
    sample = sample_rows(good, rows)
    scored = assign(sample, bundle, algorithm)
    return projection.coordinates(scored, bundle.columns, bundle.axes).drop(*bundle.columns)


def combined_view(reference: DataFrame, scored: DataFrame) -> DataFrame:
    """Reference and new rows in one table, tagged with their origin."""
    return reference.withColumn("origin", F.lit("Reference")).unionByName(
        scored.withColumn("origin", F.lit("Uploaded")), allowMissingColumns=True
    )
