"""Small helpers the corpus operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.session import bounded_batches, shared_folder

# Words as every contract of this subpackage states them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; any executor can read it again."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remainder_of_id(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about equal bytes, one row at least."""
    parts = max(1, min(batch.num_rows, -(-batch.nbytes // most_bytes)))
    step = max(1, -(-batch.num_rows // parts))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def worker_memory(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next, such as a loaded vocabulary.

    Task functions travel by value, so their own module does not outlive a task.  Whatever is
    kept must be rebuildable and bounded: a new worker starts without it.
    """
    kept = sys.modules.setdefault("tripmill_worker_memory", types.ModuleType("tripmill_worker_memory"))
    if key not in kept.__dict__:
        setattr(kept, key, make())
    return getattr(kept, key)


def forget(key: str) -> None:
    """Free what a worker keeps under a name, before tasks that have no use for it."""
    kept = sys.modules.get("tripmill_worker_memory")
    if kept is not None:
        kept.__dict__.pop(key, None)
