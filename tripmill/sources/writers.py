"""Sinks: Parquet for row data, CSV and JSON for small reports, versioned result tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_text(df: DataFrame) -> DataFrame:
    """Columns as CSV can hold them: arrays as JSON, booleans as lower-case words."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        elif isinstance(field.dataType, T.BooleanType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def save_csv(df: DataFrame, path: str) -> None:
    options = {"header": True, "quote": '"', "escape": '"'}
    export_text(df).write.mode("overwrite").options(**options).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document of report size (metadata, provenance, snapshots)."""
    line = spark.createDataFrame([(json.dumps(document),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


def load_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def union_records(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables with different columns: the header is their union, gaps become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# Manifest of an attempts table: a hidden folder, so readers of the data pass it over.
MANIFEST = "_committed"
MANIFEST_SCHEMA = "version bigint, attempt string, write string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The committed writes: one row each, with the number of their attempt."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def append_attempt(df: DataFrame, path: str, attempt: str) -> None:
    """Earlier attempts stay where they are; the rows of a new write become visible all at once.

    Rows go to a folder of their own, and the manifest row that names it is written last.  An
    attempt has the number of its first write, so the tenth comes after the ninth, whatever the
    attempts are called.  One writer at a time.
    """
    spark = df.sparkSession
    write = uuid.uuid4().hex
    own = df.withColumn("attempt", F.lit(str(attempt))).withColumn("write", F.lit(write))
    own.write.mode("append").partitionBy("attempt", "write").parquet(path)
    known = manifest(spark, path).agg(
        F.min(F.when(F.col("attempt") == str(attempt), F.col("version"))).alias("own"),
        F.coalesce(F.max("version"), F.lit(0)).alias("last"),
    ).first()
    version = known["own"] or known["last"] + 1
    entry = spark.createDataFrame([(version, str(attempt), write)], MANIFEST_SCHEMA)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed writes with their ``attempt`` and its ``version``; half a write is never seen."""
    found = spark.read.parquet(path).schema
    # The names of folders are text, also where they look like numbers or dates.
    names = {"attempt", "write"}
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in names else f for f in found])
    rows = spark.read.schema(schema).parquet(path)
    return rows.join(manifest(spark, path), ["attempt", "write"]).drop("write")


def latest(df: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The row with the highest version of every key (a map-side combined aggregate)."""
    rest = [name for name in df.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.col(version)).alias("__newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "__newest.*").select(*df.columns)
