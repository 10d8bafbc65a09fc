"""The tables of a study's report as one set, and the bounded views that screens show.

A report is a union of small tables in long form: (report, item, metric, value), one line for each
figure.  What goes into it comes from saved results and summaries; nothing is fitted here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmill.schema import FEATURES

# Rows that the views of a screen show.
PREVIEW_ROWS, TABLE_ROWS, CHART_ROWS, TAIL_ROWS = 100, 200, 3_000, 30
# Keys and figures of every table of the report.
MEASURES = FEATURES[:4]
REPORTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "counts": ((), ("raw_rows", "accepted_rows", "rejected_rows")),
    "exclusions": (("rejection_reason",), ("rows",)),
    "statistics": (("feature",), ("mean", "std", "min", "q50", "max")),
    "selection": (("k",), ("normalized_inertia", "silhouette", "stability_ari", "min_cluster_share")),
    "performance": (("rows", "algorithm"), ("fit_seconds",)),
    "quality": (("rows", "algorithm"), ("normalized_inertia", "silhouette")),
    "batch": (("batch_size",), ("fit_seconds", "normalized_inertia", "silhouette")),
    "profiles": (("cluster",), ("size", *MEASURES)),
    "anomalies": (("cluster",), ("outliers", "population_rows")),
    "holdout": (("row_id",), ("cluster", "anomaly_ratio")),
}


def long_form(df: DataFrame, report: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    item = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    figures = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]
    return df.select(F.lit(report).alias("report"), item.alias("item"), F.inline(F.array(*figures)))


def report_tables(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All given tables, in long form; an unknown name is an error, a missing table is left out."""
    unknown = sorted(set(parts) - set(REPORTS))
    if unknown:
        raise ValueError(f"no report has the tables {', '.join(unknown)}")
    tables = [long_form(parts[name], name, *REPORTS[name]) for name in REPORTS if name in parts]
    return reduce(DataFrame.unionByName, tables)


def head_rows(df: DataFrame, rows: int, order: Sequence[Column]) -> DataFrame:
    """The first rows of a view: a bounded top-n, combined before it leaves the tasks."""
    return df.orderBy(*order).limit(rows)


def tail_rows(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """The last rows of a view in its own order, found from the other end."""
    return df.orderBy(*[F.desc(name) for name in order]).limit(rows).orderBy(*order)
