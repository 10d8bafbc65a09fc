"""Reproducible samples: the first n rows in hash-priority order, so prefixes nest."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.functions.priority import PRIORITY_RANGE, hash_priority, unit_interval
from tripmill.operators.quantiles import find_ranks
from tripmill.schema import ROW_ID, SEED

Priority = Callable[[Column, int], Column]
# Up to here a bounded top-n is cheapest; larger prefixes are cut at their exact last value.
TOP_N_ROWS = 50_000
# Ranks of larger samples come from bins of about this many rows.
RANK_BIN_ROWS = 20_000


def with_priority(
    df: DataFrame, seed: int = SEED, key: str = ROW_ID, priority: Priority = hash_priority
) -> DataFrame:
    return df.withColumn("priority", priority(F.col(key), seed))


def prefix_cuts(ranked: DataFrame, sizes: Sequence[int], key: str = ROW_ID) -> dict[int, Column]:
    """For each n, a filter that holds for exactly the first n rows of a prioritized table.

    The n-th smallest priorities are found together by narrowing, so prefixes of any size
    are plain filters: no sort and no shuffle of rows.  Equal priorities are cut by key.
    """
    cuts = {}
    for found in find_ranks(ranked, {"priority": [n - 1 for n in sizes]}):
        n, last = found.rank + 1, int(found.low)
        if found.below + found.rows == n:
            cuts[n] = F.col("priority") <= last
            continue
        tied = ranked.filter(F.col("priority") == last)
        edge = find_ranks(tied, {key: [n - found.below - 1]})[0]
        cuts[n] = (F.col("priority") < last) | (
            (F.col("priority") == last) & (F.col(key) <= int(edge.low))
        )
    return cuts


def prefix_cut(ranked: DataFrame, n: int, key: str = ROW_ID) -> Column:
    return prefix_cuts(ranked, [n], key)[n]


def near_prefix(ranked: DataFrame, n: int) -> DataFrame:
    """The rows below a priority that keeps at least the first n rows, and few more.

    A top-n sends its n best rows of every partition to one task; behind this filter all
    partitions together hold little more than n.
    """
    total = ranked.count()
    share = (n + 8 * math.sqrt(n) + 32) / max(1, total)
    while share < 1:
        near = ranked.filter(F.col("priority") < int(share * PRIORITY_RANGE))
        if near.count() >= n:
            return near
        share *= 2
    return ranked


def sample_rows(
    df: DataFrame,
    n: int,
    seed: int = SEED,
    key: str = ROW_ID,
    priority: Priority = hash_priority,
    top_n_rows: int = TOP_N_ROWS,
) -> DataFrame:
    """Exactly min(n, rows) rows without replacement; sample_rows(n) is inside sample_rows(n + 1)."""
    ranked = with_priority(df, seed, key, priority)
    if n <= top_n_rows:
        return near_prefix(ranked, n).orderBy("priority", key).limit(n).drop("priority")
    if df.count() <= n:
        return df
    return ranked.filter(prefix_cut(ranked, n, key)).drop("priority")


def spread(sample: DataFrame, rows: int, rows_per_task: int = 2_500) -> DataFrame:
    """A top-n arrives in one partition; iterative work on it wants several."""
    parallel = sample.sparkSession.sparkContext.defaultParallelism
    return sample.repartition(max(1, min(parallel, rows // rows_per_task)))


def ranked_sample(
    df: DataFrame, n: int, seed: int = SEED, key: str = ROW_ID, priority: Priority = hash_priority
) -> DataFrame:
    """The first n rows in priority order with their one-based ``rank``, for any n.

    Beyond a bounded size the prefix is cut by a filter, and a rank is the rows of the bins before
    (one row per bin) plus the place in the row's own bin, so no task sorts the whole sample.
    """
    ranked = with_priority(df, seed, key, priority)
    if n <= TOP_N_ROWS:
        top = near_prefix(ranked, n).orderBy("priority", key).limit(n)
        return top.withColumn("rank", F.row_number().over(Window.orderBy("priority", key)))
    total = df.count()
    top = ranked if total <= n else ranked.filter(prefix_cut(ranked, n, key))
    binned = top.withColumn("__bin", hash_block(F.col("priority"), math.ceil(total / RANK_BIN_ROWS)))
    before = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("__bin").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = bins.select("__bin", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bin").orderBy("priority", key))
    return (
        binned.withColumn("__place", place)
        .join(offsets, "__bin")
        .withColumn("rank", (F.col("__before") + F.col("__place")).cast("int" if n < 2**31 else "bigint"))
        .drop("__bin", "__before", "__place")
    )


def holdout_rows(
    df: DataFrame,
    training_rows: int,
    rows: int = 30,
    seed: int = SEED,
    key: str = ROW_ID,
    priority: Priority = hash_priority,
) -> DataFrame:
    """The rows ranked right after the training prefix."""
    if training_rows + rows <= TOP_N_ROWS:
        top = ranked_sample(df, training_rows + rows, seed, key, priority)
        return top.filter(F.col("rank") > training_rows).drop("rank", "priority")
    ranked = with_priority(df, seed, key, priority)
    total = ranked.count()
    if total <= training_rows:
        return df.limit(0)
    last = min(total, training_rows + rows)
    cuts = prefix_cuts(ranked, [training_rows, last], key)
    return ranked.filter(cuts[last] & ~cuts[training_rows]).drop("priority")


def write_holdout(
    df: DataFrame,
    training_rows: int,
    out: str,
    rows: int = 30,
    seed: int = SEED,
    key: str = ROW_ID,
    priority: Priority = hash_priority,
) -> list[str]:
    """The rows after the training prefix in both input formats, in rank order; the two paths.

    The few rows are one file each, so their positions in the files are their ranks.
    """
    kept = with_priority(holdout_rows(df, training_rows, rows, seed, key, priority), seed, key, priority)
    ordered = kept.coalesce(1).sortWithinPartitions("priority", key).drop("priority")
    paths = [f"{out}/unseen.csv", f"{out}/unseen.parquet"]
    stamped = {f.name: F.col(f.name).cast("string") for f in df.schema.fields if "timestamp" in f.dataType.typeName()}
    ordered.withColumns(stamped).write.mode("overwrite").option("header", True).csv(paths[0])
    ordered.write.mode("overwrite").parquet(paths[1])
    return paths


def hash_block(priority: Column, blocks: int) -> Column:
    """Block number by priority range: blocks follow each other in priority order."""
    return F.floor(unit_interval(priority) * blocks).cast("bigint")


def rank_block(rank: Column, block_rows: int) -> Column:
    return F.floor((rank - 1) / F.lit(block_rows)).cast("int")


