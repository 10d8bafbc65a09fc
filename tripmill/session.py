"""Session settings and the folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import SparkSession

# Where tables are kept that grow with the input and are read many times: on the executors' disks.  A full store
# in memory takes more of the heap than Spark counts (likely as G1 gives its pieces of 1 MB two regions each), and
# the tasks beside it run out of memory.
KEPT = StorageLevel.DISK_ONLY
# Bytes that one Arrow batch hands to a Python worker; longer values come alone.
BATCH_BYTES = 16 << 20


def local_session(
    cpus: int | str = 8, name: str = "tripmill", settings: dict[str, str] | None = None
) -> SparkSession:
    """A session for tests and local benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "-1", "2147483647", "9223372036854775807"):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path for a written intermediate.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder, since every task then sees it.  All paths of an
    application lie in a folder of its own, which is deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tripmill-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    own = f"{base.rstrip('/')}/tripmill-{spark.sparkContext.applicationId}"
    _delete_at_end(spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    """Leave the folder to its file system, which deletes it with all intermediates as the driver's JVM ends."""
    if folder in _deleted_at_end:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    _deleted_at_end.add(folder)


_deleted_at_end: set[str] = set()
