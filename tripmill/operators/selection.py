"""Choosing K: elbow strength among candidates that pass explicit quality gates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.functions.geometry import nearest_of
from tripmill.operators import kmeans, quality
from tripmill.operators.profiles import cluster_profiles, label_rows
from tripmill.operators.sampling import sample_rows, spread
from tripmill.operators.scaling import fit_scaler, scaled_names, with_scaled
from tripmill.schema import ALTERNATIVE_SEED, FEATURES, ROW_ID, SCORES_SCHEMA, SEED
from tripmill.schema import check_features

# Candidates, rows the study runs on, rows it needs.
CANDIDATES = tuple(range(2, 11))
STUDY_ROWS = 20_000
MINIMUM_ROWS = 30


@dataclass(frozen=True)
class Gates:
    # Quality gates.
    minimum_share: float = 0.005
    minimum_silhouette: float = 0.25
    minimum_stability_ari: float = 0.8


def elbow_table(scores: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Scores (one row per K) with ``elbow_strength`` and ``eligible``.

    K and inertia are normalized between the first and the last K; the strength is how far a
    point lies below the straight line between them.
    """
    ends = scores.agg(
        F.count("k").alias("rows"),
        F.min("k").alias("k0"),
        F.max("k").alias("k1"),
        F.min_by("normalized_inertia", "k").alias("i0"),
        F.max_by("normalized_inertia", "k").alias("i1"),
        F.count_if(F.isnan("normalized_inertia") | F.col("normalized_inertia").isNull()).alias("bad"),
        F.max(F.abs("normalized_inertia")).alias("largest"),
    ).first()
    if ends["rows"] < 3 or ends["bad"] or math.isinf(ends["largest"]) or ends["i0"] <= ends["i1"]:
        raise ValueError("an elbow needs three or more K with finite, falling inertia")
    along = (F.col("k") - ends["k0"]) / F.lit(float(ends["k1"] - ends["k0"]))
    height = (F.col("normalized_inertia") - ends["i1"]) / F.lit(ends["i0"] - ends["i1"])
    passes = (
        (F.col("min_cluster_share") >= gates.minimum_share)
        & (F.col("silhouette") >= gates.minimum_silhouette)
        & (F.col("stability_ari") >= gates.minimum_stability_ari)
    )
    return scores.withColumn("elbow_strength", 1 - along - height).withColumn(
        "eligible", F.coalesce(passes, F.lit(False))
    )


def best_eligible(table: DataFrame) -> DataFrame:
    """The strongest elbow; equal strengths go to the smaller K."""
    return table.filter("eligible").orderBy(F.desc("elbow_strength"), "k").limit(1)


def choose_k(scores: DataFrame, gates: Gates = Gates()) -> tuple[int, DataFrame]:
    table = elbow_table(scores, gates)
    winner = best_eligible(table).select("k").first()
    if winner is None:
        raise ValueError("every K fails a quality gate; the candidate profiles show why")
    return winner["k"], table


def best_silhouette(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))


def gate_sensitivity(scores: DataFrame, shares: Sequence[float], gates: Gates = Gates()) -> DataFrame:
    """The K each minimum share would choose (null if none passes), with how many candidates pass."""
    table = elbow_table(scores, gates)
    quality_ok = (F.col("silhouette") >= gates.minimum_silhouette) & (
        F.col("stability_ari") >= gates.minimum_stability_ari
    )
    each = table.withColumn(
        "minimum_share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    )
    passes = F.coalesce(quality_ok & (F.col("min_cluster_share") >= F.col("minimum_share")), F.lit(False))
    order = F.struct("elbow_strength", -F.col("k"))
    return each.groupBy("minimum_share").agg(
        F.max_by(F.when(passes, F.col("k")), F.when(passes, order)).alias("k"),
        F.count_if(passes).alias("eligible"),
    )


def with_labels(df: DataFrame, columns: Sequence[str], models: Sequence[np.ndarray]) -> DataFrame:
    """Array column ``labels``: the cluster of the row in each model, in one batch function."""

    @F.pandas_udf("array<int>")
    def label(*values: pd.Series) -> pd.Series:
        x = np.column_stack(values).astype("float64")
        every = np.column_stack([nearest_of(x, centers)[0] for centers in models])
        return pd.Series(list(every.astype("int32")))

    return df.withColumn("labels", label(*columns))


@dataclass
class Study:
    k: int
    table: DataFrame
    profiles: DataFrame
    summary: dict


def study_k(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    candidates: Sequence[int] = CANDIDATES,
    restarts: int = kmeans.RESTARTS,
    rows: int = STUDY_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Scores and candidate profiles.  All K, both seeds and all restarts share each pass."""
    features = check_features(features)
    spark = df.sparkSession
    sample = spread(sample_rows(df, rows), rows).persist()
    count = sample.count()
    if count < MINIMUM_ROWS:
        raise ValueError(f"a K study needs {MINIMUM_ROWS} accepted rows, found {count}")
    columns = scaled_names(features)
    scaled = with_scaled(sample, fit_scaler(sample, features)).persist()
    wanted = {(k, seed): (k, seed, restarts) for seed in (SEED, ALTERNATIVE_SEED) for k in candidates}
    drawn = kmeans.drawn_starts(scaled, columns, ROW_ID, wanted)
    starts = {name: kmeans.distinct_centers(found) for name, found in drawn.items()}
    fits = kmeans.fit_many(scaled.select(*columns), starts)
    models = [fits[k, s].centers for s in (SEED, ALTERNATIVE_SEED) for k in candidates]
    labeled = with_labels(scaled, columns, models).persist()
    sample.unpersist()
    size = len(candidates)

    first = F.slice("labels", 1, size)
    second = F.slice("labels", size + 1, size)
    ks = F.array(*[F.lit(k) for k in candidates])
    paired = labeled.select(
        F.inline(F.arrays_zip(ks.alias("k"), first.alias("a"), second.alias("b")))
    )
    stability = {row["k"]: row["ari"] for row in quality.adjusted_rand(paired, "a", "b", ["k"]).collect()}

    metric = sample_rows(labeled, quality.SILHOUETTE_ROWS, ALTERNATIVE_SEED)
    metric = metric.select(*columns, *[F.col("labels")[i].alias(f"l{i}") for i in range(size)])
    widths = quality.silhouettes(metric, columns, [f"l{i}" for i in range(size)])

    rows_ = []
    for i, k in enumerate(candidates):
        fit = fits[k, SEED]
        rows_.append(
            (
                k,
                fit.rows,
                fit.normalized_inertia,
                widths[f"l{i}"],
                stability[k],
                min(fit.sizes) / fit.rows,
                max(fit.sizes) / fit.rows,
                fit.sizes,
            )
        )
    scores = spark.createDataFrame(rows_, SCORES_SCHEMA)
    own = labeled.withColumn("labels", first)
    profiles = cluster_profiles(label_rows(own, "labels", list(candidates)), ["k"], FEATURES)
    return scores, profiles


def analyze(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    gates: Gates = Gates(),
    restarts: int = kmeans.RESTARTS,
    rows: int = STUDY_ROWS,
) -> Study:
    """The whole selection: scores, gates, the chosen K and why."""
    scores, profiles = study_k(df, features, restarts=restarts, rows=rows)
    chosen, table = choose_k(scores, gates)
    listed = {row["k"]: row for row in table.collect()}
    winner = listed[chosen]
    eligible = sorted(k for k, row in listed.items() if row["eligible"])
    summary = {
        "k": chosen,
        "rule": "largest elbow strength among the K that pass every quality gate",
        "rationale": (
            f"K={chosen} has the largest elbow strength among {eligible}; silhouette "
            f"{winner['silhouette']:.3f}, smallest cluster {winner['min_cluster_share']:.2%}, "
            f"stability ARI {winner['stability_ari']:.3f}. The best silhouette is at "
            f"K={best_silhouette(scores).first()['k']}."
        ),
        "selection_rows": winner["rows"],
        "silhouette_rows": min(quality.SILHOUETTE_ROWS, winner["rows"]),
        "seed": SEED,
        "stability_seed": ALTERNATIVE_SEED,
        "restarts": restarts,
        "eligible_k": eligible,
        "gates": {
            "minimum_share": gates.minimum_share,
            "minimum_silhouette": gates.minimum_silhouette,
            "minimum_stability_ari": gates.minimum_stability_ari,
        },
    }
    return Study(chosen, table, profiles, summary)
