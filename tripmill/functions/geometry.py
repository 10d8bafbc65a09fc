"""Distances to centroids.

A model is a few dozen numbers, so its centroids enter the plan as literals: rows are
assigned in the scan stage, with no join and no shuffle.  Wide models (many clusters times
many dimensions) would make generated code too large to compile well; those go through one
Arrow batch function that multiplies matrices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LITERALS = 160


def squared_distance(columns: Sequence[Column], center: Sequence[float]) -> Column:
    gaps = [column - F.lit(float(value)) for column, value in zip(columns, center, strict=True)]
    return reduce(add, [gap * gap for gap in gaps])


def nearest_of(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the closest center; ties go to the lowest index.

    Differences are squared as in the column expressions, so both ways give the same labels.
    """
    smallest = np.full(len(x), np.inf)
    labels = np.zeros(len(x), dtype="int64")
    for number, center in enumerate(centers):
        gaps = x - center
        squares = np.einsum("ij,ij->i", gaps, gaps)
        nearer = squares < smallest
        smallest[nearer], labels[nearer] = squares[nearer], number
    return labels, smallest


def _nearest_batches(centers: np.ndarray, packed: bool):
    @F.pandas_udf("struct<cluster:int,squared_distance:double>")
    def nearest(*columns: pd.Series) -> pd.DataFrame:
        x = np.stack(columns[0].to_numpy()) if packed else np.column_stack(columns)
        labels, squares = nearest_of(x.astype("float64"), centers)
        return pd.DataFrame({"cluster": labels.astype("int32"), "squared_distance": squares})

    return nearest


def nearest_columns(distances: Column) -> tuple[Column, Column]:
    """Cluster and squared distance from an array column of squared distances."""
    smallest = F.array_min(distances)
    return (F.array_position(distances, smallest) - 1).cast("int"), smallest


def distance_array(inputs: Sequence[str], centers: np.ndarray) -> Column:
    columns = [F.col(name) for name in inputs]
    return F.array(*[squared_distance(columns, center) for center in centers])


def with_nearest(df: DataFrame, inputs: Sequence[str] | str, centers: np.ndarray) -> DataFrame:
    """Add ``cluster`` and ``squared_distance``.

    ``inputs`` is a list of numeric columns, or the name of one array column.
    """
    centers = np.asarray(centers, dtype="float64")
    packed = isinstance(inputs, str)
    if not packed and centers.size <= MAX_LITERALS:
        cluster, smallest = nearest_columns(F.col("__distances"))
        return (
            df.withColumn("__distances", distance_array(inputs, centers))
            .withColumns({"squared_distance": smallest, "cluster": cluster})
            .drop("__distances")
        )
    arguments = [inputs] if packed else list(inputs)
    found = _nearest_batches(centers, packed)(*arguments)
    return (
        df.withColumn("__nearest", found)
        .withColumn("cluster", F.col("__nearest.cluster"))
        .withColumn("squared_distance", F.col("__nearest.squared_distance"))
        .drop("__nearest")
    )
