"""Feature summaries and cluster profiles in original units."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.functions.labels import profile_text
from tripmill.operators.quantiles import EXACT_ROWS, column_statistics, known_columns, quantiles
from tripmill.schema import PROFILE_COLUMNS

QUARTILES = (0.25, 0.5, 0.75)
STATISTICS = ("count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max")


def feature_summary(
    df: DataFrame, features: Sequence[str], exact_rows: int = EXACT_ROWS, saved: DataFrame | None = None
) -> DataFrame:
    """One row per feature: counts, mean, sample deviation, extremes and exact quartiles.

    ``saved`` has statistics merged from parts of the table, which spares a scan.
    """
    known = known_columns(column_statistics(df, features) if saved is None else saved)
    found = quantiles(df, {name: QUARTILES for name in features}, exact_rows, known)
    rows = []
    for name in features:
        own = known[name]
        n = own["rows"]
        deviation = math.sqrt(max(0.0, own["squares"]) / (n - 1)) if n > 1 else None
        quartiles = [found[name, q] for q in QUARTILES]
        rows.append((name, n, own["nulls"], own["mean"], deviation, own["low"], *quartiles, own["high"]))
    schema = "feature string, count bigint, null_count bigint, mean double, std double, min double"
    schema += "".join(f", `{q:.0%}` double" for q in QUARTILES) + ", max double"
    return df.sparkSession.createDataFrame(rows, schema)


def statistic_rows(summary: DataFrame) -> DataFrame:
    """The summary with one row per statistic, as reports show it."""
    values = [F.col(f"`{name}`").cast("double").alias(name) for name in STATISTICS]
    long = summary.select("feature", *values).unpivot(
        "feature", list(STATISTICS), "statistic", "value"
    )
    return long.groupBy("statistic").pivot("feature").agg(F.first("value"))


def cluster_profiles(
    labeled: DataFrame, by: Sequence[str] = (), columns: Sequence[str] = PROFILE_COLUMNS
) -> DataFrame:
    return labeled.groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(name).alias(name) for name in columns]
    )


def label_rows(df: DataFrame, labels: str, ids: Sequence, name: str = "k") -> DataFrame:
    """Long form of an array of labels, one entry per model id."""
    models = F.array(*[F.lit(i) for i in ids])
    pairs = F.arrays_zip(models.alias(name), F.col(labels).alias("cluster"))
    rest = [column for column in df.columns if column != labels]
    return df.select(*rest, F.inline(pairs))


def with_descriptions(profiles: DataFrame) -> DataFrame:
    text = profile_text(
        F.col("trip_distance"),
        F.col("duration_minutes"),
        F.col("speed_mph"),
        F.col("hour_sin"),
        F.col("hour_cos"),
    )
    return profiles.withColumn("cluster_description", text)


def describe_clusters(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach profile text (k rows, so broadcast); unknown clusters get a default."""
    texts = with_descriptions(profiles).select("cluster", "cluster_description")
    joined = df.join(F.broadcast(texts), "cluster", "left")
    missing = F.lit("Profile unavailable")
    return joined.withColumn("cluster_description", F.coalesce("cluster_description", missing))


def distribution(df: DataFrame) -> DataFrame:
    """Sizes per cluster, from a profile table or by counting rows."""
    if "size" in df.columns:
        return df.select("cluster", "size")
    return df.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def with_share(sizes: DataFrame) -> DataFrame:
    """Share of every cluster (the input has one row per cluster)."""
    total = sizes.agg(F.sum("size")).first()[0]
    return sizes.withColumn("share", F.col("size") / F.lit(total))
