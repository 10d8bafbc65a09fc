"""Hash priorities: a reproducible pseudo-random order that needs no shuffle to compute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripmill.schema import SEED

# 52 bits: every priority is an exact double, so numeric order cuts can work on it.
PRIORITY_BITS = 52
PRIORITY_RANGE = 1 << PRIORITY_BITS


def hash_priority(key: Column, seed: int = SEED) -> Column:
    """Fast priority for sampling inside Spark."""
    mixed = F.xxhash64(key, F.lit(seed))
    return F.shiftrightunsigned(mixed, 64 - PRIORITY_BITS)


def portable_priority(key: Column, seed: int = SEED) -> Column:
    """The same idea from md5, which other engines can recompute."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, PRIORITY_BITS // 4), 16, 10).cast("bigint")


def unit_interval(priority: Column) -> Column:
    return priority / F.lit(float(PRIORITY_RANGE))
