"""Reading trips and result tables.

Every scanned row gets a ``row_id``: its zero-based position in the input, counted over the
files in path order.  Positions come from the file reader, never from a global sort.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.schema import REQUIRED, ROW_ID

# Admission limits of an upload.
UPLOAD_ROWS = 100_000
UPLOAD_BYTES = 20 * 1024**2
# Above this many files or blocks the offsets are joined without a broadcast hint.
BROADCAST_BLOCKS = 100_000


def file_format(path: str) -> str:
    suffix = PurePosixPath(str(path).rstrip("/")).suffix.lower()
    if suffix not in (".csv", ".parquet"):
        raise ValueError(f"cannot read {path}: only .csv and .parquet are supported")
    return suffix[1:]


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The file as it is.  CSV columns stay text; parsing is the cleaner's business."""
    if file_format(path) == "parquet":
        return spark.read.parquet(path)
    names = _csv_header(spark, path)
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.read.option("header", True).option("enforceSchema", False).schema(text).csv(path)


def check_contract(df: DataFrame) -> None:
    absent = [name for name in sorted(REQUIRED) if name not in df.columns]
    if absent:
        raise ValueError(f"the trips lack these columns: {', '.join(absent)}")


def _block_offsets(blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows before each block.  One row per file or split, so a single window is fine here."""
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    counted = counted.persist()
    return counted, counted.count()


def _join_offsets(df: DataFrame, offsets: DataFrame, count: int, keys: list[str]) -> DataFrame:
    side = F.broadcast(offsets) if count <= BROADCAST_BLOCKS else offsets
    return df.join(side, keys, "left")


def with_row_position(df: DataFrame, fmt: str) -> DataFrame:
    """Add ``row_id`` to a file scan, replacing any column of that name in the data."""
    names = [name for name in df.columns if name != ROW_ID]
    single = df.isStreaming or len(df.inputFiles()) <= 1
    if fmt == "parquet":
        index = F.col("_metadata.row_index").cast("bigint")
        if single:
            return df.select(index.alias(ROW_ID), *names)
        keys = ["__file"]
        located = df.select(*names, F.col("_metadata.file_path").alias("__file"), index.alias(ROW_ID))
        # Counting rows of files asks for no column, so this scan reads footers and no data.
        blocks = df.select(F.col("_metadata.file_path").alias("__file"))
        blocks = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
        offsets, count = _block_offsets(blocks, keys)
        joined = _join_offsets(located, offsets, count, keys)
        return joined.select((F.col(ROW_ID) + F.col("__before")).alias(ROW_ID), *names)

    # Text splits carry no row index, so the rows of each split are counted.
    located = df.select(
        *names,
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__serial"),
    )
    return _from_serials(located, ["__file", "__start"], names)


def number_rows(df: DataFrame) -> DataFrame:
    """Positions for rows that do not come straight from files, in partition order.

    The table is evaluated twice, so it should be persisted or otherwise repeatable.
    """
    names = [name for name in df.columns if name != ROW_ID]
    located = df.select(
        *names,
        F.spark_partition_id().alias("__partition"),
        F.monotonically_increasing_id().alias("__serial"),
    )
    return _from_serials(located, ["__partition"], names)


def _from_serials(located: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Turn serial numbers that are consecutive within each block into positions.

    The guard stops the job should the second evaluation be split differently.
    """
    blocks = located.groupBy(*keys).agg(
        F.min("__serial").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    offsets, count = _block_offsets(blocks, keys)
    joined = _join_offsets(located, offsets, count, keys)
    inside = F.col("__serial") - F.col("__first")
    stable = F.coalesce((inside >= 0) & (inside < F.col("__rows")), F.lit(False))
    position = F.when(stable, inside + F.col("__before")).otherwise(
        F.raise_error(F.lit("the rows were split differently between two scans")).cast("bigint")
    )
    return joined.select(position.alias(ROW_ID), *names)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Trips with their input position; extra columns are left in the file."""
    raw = read_raw(spark, path)
    check_contract(raw)
    return with_row_position(raw, file_format(path)).select(ROW_ID, *REQUIRED)


class TooLarge(ValueError):
    """A source beyond the admission limits; ``rows`` is known once its bytes are admitted."""

    def __init__(self, message: str, rows: int | None = None):
        super().__init__(message)
        self.rows = rows


def bounded_scan(
    spark: SparkSession, path: str, max_rows: int = UPLOAD_ROWS, max_bytes: int = UPLOAD_BYTES
) -> DataFrame:
    """A scan that refuses oversized uploads before any other work.

    Bytes come from the listing; rows of Parquet from the footers, of text up to the limit.
    """
    size = file_sizes(spark, path).agg(F.sum("bytes")).first()[0]
    if size > max_bytes:
        raise TooLarge(f"{path} has {size} bytes; at most {max_bytes} are accepted")
    raw = read_raw(spark, path)
    check_contract(raw)
    rows = raw.select().count() if file_format(path) == "parquet" else raw.limit(max_rows + 1).count()
    if rows > max_rows:
        raise TooLarge(f"{path} has more than {max_rows} rows; split the file", rows)
    return scan(spark, path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size per source file (files must stay below 2 GB each)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")
    )


def source_digest(spark: SparkSession, path: str) -> dict:
    """One digest, the bytes and the number of all files of a source.

    A single file has its own SHA-256.  Several are summed up without an order: four numbers of
    each file's name, hash and size are added, so any number of files leaves one row.
    """
    files = fingerprint(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    own = F.sha2(F.concat_ws("|", name, "sha256", F.col("bytes").cast("string")), 256)
    parts = [F.conv(F.substring(own, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    row = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.min("sha256").alias("only"),
        F.sha2(F.concat_ws("|", F.count(F.lit(1)), *[F.sum(p) for p in parts]), 256).alias("all"),
    ).first()
    sha = row["only"] if row["files"] == 1 else row["all"]
    return {"sha256": sha, "bytes": row["bytes"], "files": row["files"]}


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A saved result table, or an empty one when nothing was saved yet."""
    reader = spark.read.schema(schema)
    try:
        if file_format(path) == "csv":
            return _decode_arrays(spark, path, schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _decode_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV holds arrays as JSON text."""
    flat = T.StructType()
    for field in schema.fields:
        packed = isinstance(field.dataType, T.ArrayType)
        flat.add(field.name, T.StringType() if packed else field.dataType)
    options = {"header": True, "quote": '"', "escape": '"'}
    df = spark.read.options(**options).schema(flat).csv(path)
    return df.select(
        *[
            F.from_json(field.name, field.dataType).alias(field.name)
            if isinstance(field.dataType, T.ArrayType)
            else F.col(field.name)
            for field in schema.fields
        ]
    )


