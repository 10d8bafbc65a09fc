"""Shards of near equal bytes by a minimax contiguous partition.

Equal texts form a group, groups lie in the order of their text hash, and a shard is a range of
that order.  Neighbouring groups share one of 2^18 hash ranges, which are the atoms: the driver
holds one number per atom whatever the table's size.  The smallest capacity that lets a greedy
walk fit all atoms into the shards is found by binary search.  The cuts are then made inside
what that capacity allows, each as near as possible to an even share of the rest, so that one
group larger than a shard does not empty the others.

Slots are offsets of small bins plus a rank inside the bin, so no task sorts a whole shard.

Nulls: a null text is an empty one, a null id an id like any other.  Repeated rows take slots of
their own.  An empty table gives an empty result, and with fewer atoms than shards some shards
stay empty.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.llm.common import whole_text, written

SHARDS = 24
ATOM_BITS = 18
# Bins of a shard for its slots; the table of bins is broadcast and has SHARDS x SLOT_BINS rows.
SLOT_BINS = 4096
ROW_BYTES = 8


def furthest(ends: np.ndarray, at: int, capacity: int) -> int:
    """Index behind the last atom that fits with those from ``at`` on."""
    before = int(ends[at - 1]) if at else 0
    return int(np.searchsorted(ends, before + capacity, side="right"))


def fits(ends: np.ndarray, shards: int, capacity: int) -> bool:
    at = 0
    for _ in range(shards):
        at = furthest(ends, at, capacity)
    return at >= len(ends)


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    ends = np.cumsum(sizes)
    low = max(int(sizes.max()), -(-int(ends[-1]) // shards))
    high = int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(ends, shards, middle) else (middle + 1, high)
    return low


def cut_points(sizes: np.ndarray, shards: int) -> list[int]:
    """Index of the first atom of every shard but the first; no shard exceeds the capacity."""
    if not len(sizes):
        return [0] * (shards - 1)
    capacity = smallest_capacity(sizes, shards)
    ends = np.cumsum(sizes)
    total, n = int(ends[-1]), len(sizes)
    # The least index that leaves the shards behind it no more than they can hold.
    least = [n] * (shards + 1)
    for k in range(shards - 1, -1, -1):
        after = int(ends[least[k + 1] - 1]) if least[k + 1] else 0
        least[k] = int(np.searchsorted(ends, after - capacity, side="left")) + 1 if after > capacity else 0
    cuts, at = [], 0
    for k in range(1, shards):
        before = int(ends[at - 1]) if at else 0
        ideal = before + (total - before) / (shards - k + 1)
        near = int(np.searchsorted(ends, ideal, side="left")) + 1
        if near > 1 and near - 1 > at and ideal - ends[near - 2] <= ends[min(near, n) - 1] - ideal:
            near -= 1
        at = min(max(near, least[k], at), furthest(ends, at, capacity), n)
        cuts.append(at)
    return cuts


def atom_of(group: Column) -> Column:
    return F.shiftrightunsigned(group, 64 - ATOM_BITS)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and a null ``grown_shard``."""
    text = whole_text(text_column)
    group = F.xxhash64(text)
    narrow = written(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            atom_of(group).alias("atom"),
            F.xxhash64(F.col(id_column), group).alias("order"),
        ),
        "shard-rows",
    )
    atoms = narrow.groupBy("atom").agg(F.sum("size").alias("size")).toArrow().sort_by("atom")
    starts = atoms["atom"].to_numpy()
    cuts = cut_points(atoms["size"].to_numpy(), shards)
    shard = F.lit(0)
    for cut in cuts:
        if cut < len(starts):
            shard = shard + (F.col("atom") >= int(starts[cut])).cast("int")
    placed = narrow.withColumns({"shard": shard, "bin": F.pmod("order", F.lit(SLOT_BINS))})
    bins = placed.groupBy("shard", "bin").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(
        "shard", "bin", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    rank = Window.partitionBy("shard", "bin").orderBy("order", "id", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(rank) - 1)
    return ranked.join(F.broadcast(offsets), ["shard", "bin"]).select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
