"""Comparing result tables: imports, pairs, chart data and experiment identity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.functions.features import not_finite
from tripmill.functions.labels import series_label
from tripmill.schema import ALGORITHMS, STATUSES

# What an imported result table must bring, and which metrics are checked.
IMPORT_COLUMNS = (
    "algorithm",
    "rows",
    "status",
    "environment",
    "seed",
    "k",
    "feature_count",
    "streaming",
    "experiment_id",
)
MATCHED_COLUMNS = ("seed", "k", "feature_count", "experiment_id")
# What every finished run of this project reports (see ``RESULTS_SCHEMA``).
METRICS = ("fit_seconds", "normalized_inertia", "silhouette")
CHART_METRICS = METRICS
LOCAL = "local"
REMOTE = "colab"


def with_environment(df: DataFrame, environment: str = LOCAL) -> DataFrame:
    if "environment" in df.columns:
        return df
    return df.withColumn("environment", F.lit(environment))


def _absent(column: Column) -> Column:
    return F.coalesce(~column, F.lit(True))


def import_violations(
    local: DataFrame,
    imported: DataFrame,
    remote: str = REMOTE,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Broken rows per check, checks in the order they matter.

    Row checks are one aggregate; membership checks are anti joins on the distinct keys.
    """
    checks: dict[str, Column] = {
        "environment": _absent(F.col("environment") == remote),
        "algorithm": _absent(F.col("algorithm").isin(*ALGORITHMS)),
        "status": _absent(F.col("status").isin(*STATUSES)),
        "rows": _absent(F.col("rows") > 0),
    }
    done = F.coalesce(F.col("status") == "ok", F.lit(False))
    for name in metrics:
        if name not in imported.columns:
            checks[name] = done
            continue
        value = F.col(name).try_cast("double")
        wrong = ~value.between(-1, 1) if name == "silhouette" else value < 0
        checks[name] = done & (not_finite(value) | wrong)
    row_checks = imported.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    broken = row_checks.unpivot([], list(checks), "check", "violations")
    for name in MATCHED_COLUMNS:
        keys = local.select(name).distinct()
        unknown = imported.join(keys, name, "left_anti")
        broken = broken.unionByName(
            unknown.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
        )
    return broken


def _align(local: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give shared columns one type: text wins over numbers, wider numbers over narrower."""
    order = (T.BooleanType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType)

    def rank(kind: T.DataType) -> int:
        return order.index(type(kind)) if type(kind) in order else len(order)

    left = {f.name: f.dataType for f in local.schema.fields}
    right = {f.name: f.dataType for f in imported.schema.fields}
    wider = {
        name: max(left[name], right[name], key=rank)
        for name in left
        if name in right and left[name] != right[name]
    }
    casts = {name: F.col(name).cast(kind) for name, kind in wider.items()}
    return (local.withColumns(casts), imported.withColumns(casts)) if casts else (local, imported)


def combine_results(
    local: DataFrame,
    imported: DataFrame | None = None,
    remote: str = REMOTE,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Local results, plus imported ones if every check passes."""
    local = with_environment(local)
    if imported is None:
        return local
    absent = [name for name in sorted(IMPORT_COLUMNS) if name not in imported.columns]
    if absent:
        raise ValueError(f"the imported results lack: {', '.join(absent)}")
    if imported.isEmpty():
        raise ValueError(f"the imported results are empty; rows of environment={remote} expected")
    broken = import_violations(local, imported, remote, metrics).filter("violations > 0").collect()
    if broken:
        found = ", ".join(f"{row['check']} ({row['violations']} rows)" for row in broken)
        raise ValueError(f"the imported results are refused: {found}")
    local, imported = _align(local, imported)
    return local.unionByName(imported, allowMissingColumns=True)


def successful(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "ok")


def matching(df: DataFrame, k: int, experiment_id: str | None = None) -> DataFrame:
    """Results of the active model only."""
    rows = df.filter(F.col("k") == k)
    return rows if experiment_id is None else rows.filter(F.col("experiment_id") == experiment_id)


def paired_results(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Both algorithms side by side at equal rows and environment (block fits excluded)."""
    keys = ["rows", "environment"]
    plain = successful(df).filter(~F.col("streaming"))
    sides = []
    for name, tag in zip(ALGORITHMS, ("kmeans", "minibatch"), strict=True):
        columns = [F.col(metric).alias(f"{tag}_{metric}") for metric in metrics]
        sides.append(plain.filter(F.col("algorithm") == name).select(*keys, *columns))
    return sides[0].join(sides[1], keys)


def largest_pair(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return paired_results(df, metrics).orderBy(F.desc("rows"), "environment").limit(1)


def comparison_rows(df: DataFrame, metrics: Sequence[str] = CHART_METRICS) -> DataFrame:
    """Chart data: one row per size, series and metric."""
    label = series_label(F.col("environment"), F.col("algorithm"), streaming=F.col("streaming"))
    wide = successful(df).withColumn("series", label)
    present = [name for name in metrics if name in df.columns]
    ids = ["rows", "algorithm", "series"]
    doubles = [F.col(name).cast("double").alias(name) for name in present]
    return wide.select(*ids, *doubles).unpivot(ids, present, "metric", "value")


def batch_view(df: DataFrame, k: int) -> DataFrame:
    """Finished batch sizes of the active model, with the fastest and the best of them marked."""
    own = Window.partitionBy("k")
    ok = matching(successful(df), k)
    return ok.select(
        "batch_size",
        "fit_seconds",
        "normalized_inertia",
        "silhouette",
        (F.col("fit_seconds") == F.min("fit_seconds").over(own)).alias("fastest"),
        (F.col("normalized_inertia") == F.min("normalized_inertia").over(own)).alias("best"),
    )


def experiment_id(saved: dict) -> str:
    """SHA-256 of the sorted, compact JSON of a frozen snapshot (a few hundred bytes)."""
    text = json.dumps(saved, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def row_identity(columns: Sequence[Column]) -> Column:
    """The same idea for table rows: a digest of the canonical text of some columns."""
    return F.sha2(F.concat_ws(",", *columns), 256)
