"""Two- and three-dimensional views: principal axes fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmill.operators.sampling import sample_rows
from tripmill.schema import ROW_ID, SEED

# Rows used to fit the axes, rows that get coordinates when scoring.
FIT_ROWS = 5_000
CHART_ROWS = 2_000
DIMENSIONS = (2, 3)


def coordinate_name(dimensions: int, axis: int) -> str:
    return f"pca{dimensions}_{axis + 1}"


def fit_axes(
    scaled: DataFrame, columns: Sequence[str], rows: int = FIT_ROWS
) -> dict[int, np.ndarray]:
    """Loadings (columns x dimensions) per view."""
    sample = sample_rows(scaled.select(ROW_ID, *columns), rows)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="x").transform(sample).select("x")
    usable = [d for d in DIMENSIONS if d <= len(columns)]
    if not usable:
        return {}
    # Principal axes are ordered, so the smaller view is a prefix of the larger one.
    model = PCA(k=max(usable), inputCol="x", outputCol="y").fit(vectors)
    loadings = model.pc.toArray()
    return {d: loadings[:, :d].copy() for d in usable}


def _coordinate(columns: Sequence[str], weights: np.ndarray) -> Column:
    return sum(
        (F.col(name) * F.lit(float(w)) for name, w in zip(columns, weights, strict=True)), F.lit(0.0)
    )


def coordinates(df: DataFrame, columns: Sequence[str], axes: Mapping[int, np.ndarray]) -> DataFrame:
    placed = {
        coordinate_name(d, axis): _coordinate(columns, loadings[:, axis])
        for d, loadings in axes.items()
        for axis in range(d)
    }
    return df.withColumns(placed) if placed else df


def attach_coordinates(
    scored: DataFrame,
    columns: Sequence[str],
    axes: Mapping[int, np.ndarray],
    chart_rows: int = CHART_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Every scored row stays; only ``chart_rows`` sampled rows get coordinates.

    The sample is a bounded top-n by hash, small enough to broadcast for the left join.
    """
    names = [coordinate_name(d, axis) for d in axes for axis in range(d)]
    if not names:
        return scored
    sample = sample_rows(scored.select(ROW_ID, *columns), chart_rows, seed)
    placed = coordinates(sample, columns, axes).select(ROW_ID, *names)
    side = F.broadcast(placed) if chart_rows <= FIT_ROWS * 10 else placed
    return scored.join(side, ROW_ID, "left")


def charted(df: DataFrame, dimensions: int) -> DataFrame | None:
    """Rows with coordinates, or nothing to draw when the view was never fitted."""
    names = [coordinate_name(dimensions, axis) for axis in range(dimensions)]
    if not set(names) <= set(df.columns):
        return None
    return df.dropna(subset=names)
