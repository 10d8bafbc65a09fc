"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most four bits exactly if the balls of radius two around them meet.
So every distinct fingerprint stands for all its variants within two flips (2,081 of them),
the shuffle brings equal variants together, and fingerprints that meet are linked.

The shuffle is on the leading bits of the variants: a fingerprint is sent once to each prefix that
one of its variants has (37 rows for 8 bits), and the variants of that prefix are written out
where they are compared.  Nothing is left out by that: a variant belongs to one prefix.  The
fingerprints of a prefix with too many variants are sent on to prefixes of four more bits, with
the flips they have left, and so on: each such round divides the rows as well as the variants.  At
64 bits a prefix is a variant, and only 2,081 fingerprints can meet there, so every group is
bounded.  A group returns a spanning forest of its verified links, at most one row per fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.llm.common import bounded_batches, slices, spare_name, whole_text, written
from tripmill.llm.components import smallest_labels

SHINGLE = 4
SEED = 42
RADIUS = 4
HALF = RADIUS // 2
BITS = 64
# Variants that one prefix is to have on average and at most.
VARIANTS_PER_PREFIX = 2_000_000
MOST_VARIANTS = 4_000_000
LEAST_PREFIX_BITS = 6
# Bits by which a crowded prefix grows in a round.
MORE_BITS = 4
# Bits set in each byte value.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


# ---- fingerprints ----------------------------------------------------------------------------


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -SHINGLE] + 1])
    hashes = [
        xxh64_intdigest(joined[a:b], SEED)
        for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())
    ]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed number: a bit is set if over half of the hashes have it."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    seen = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    counts = (seen @ BYTE_BITS.astype(np.int64)).ravel()
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(
    docs: DataFrame, id_column: str, text_column: str, others: Sequence[str] = ()
) -> DataFrame:
    """``id``, other columns and ``fp`` (signed) of every whole text; a null text has no words."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), *others, whole_text(text_column).alias("text"))
    names = ["id", *others, "fp"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                *kept, texts = batch.columns
                marks = [majority(shingle_hashes(t)) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.int64())], names=names)

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return source.mapInArrow(compute, schema)


# ---- balls -----------------------------------------------------------------------------------


def flips(bits: int, most: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``most`` (two at the utmost) set."""
    masks = [0]
    if most > 0:
        masks += [1 << a for a in range(bits)]
    if most > 1:
        masks += [1 << a | 1 << b for a in range(bits) for b in range(a)]
    return masks


def forest(left: np.ndarray, right: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node that each node is linked with."""
    root = np.arange(nodes)
    while True:
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            return root
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]


def meetings(fps: np.ndarray, route: int, prefix_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near fingerprints that share a variant of this prefix."""
    rest = BITS - prefix_bits
    distance = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(route))
    suffix = fps & np.uint64((1 << rest) - 1)
    values, owners = [], []
    for left in range(HALF + 1):
        mask = np.array(flips(rest, left), np.uint64)
        own = np.flatnonzero(distance == HALF - left).astype(np.int32)
        values.append((suffix[own, None] ^ mask).ravel())
        owners.append(np.repeat(own, len(mask)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    del values, owners
    # Only variants seen twice matter: sort the values alone, then look the few up.
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return owner[:0], owner[:0]
    place = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    met = twice[place] == value
    owner, place = owner[met], place[met]
    order = np.lexsort((owner, place))
    owner, place = owner[order], place[order]
    a, b = owner[np.searchsorted(place, place)], owner
    near = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
    return a[near], b[near]


def sent_on(routed: DataFrame, before: int, more: int) -> DataFrame:
    """Each row once for every prefix of ``more`` further bits that its remaining flips reach."""
    next_bits = F.shiftrightunsigned("fp", BITS - before - more).bitwiseAND((1 << more) - 1)
    masks = F.array(*[F.lit(m).cast("bigint") for m in flips(more, HALF)])
    reached = masks if not before else F.filter(masks, lambda m: F.bit_count(m) <= F.col("left"))
    return routed.select("fp", "route", "left", F.explode(reached).alias("mask")).select(
        "fp",
        F.shiftleft("route", more).bitwiseOR(next_bits.bitwiseXOR(F.col("mask"))).alias("route"),
        (F.col("left") - F.bit_count("mask")).alias("left"),
    )


def bounded_routes(distinct: DataFrame, prefix_bits: int) -> DataFrame:
    """``fp``, ``route`` and its ``bits``: groups of at most ``MOST_VARIANTS``, or of 64 bits."""
    start = distinct.select("fp", F.lit(0).cast("bigint").alias("route"), F.lit(HALF).alias("left"))
    bits, routed, groups = prefix_bits, sent_on(start, 0, prefix_bits), []
    while True:
        here = lambda rows: rows.select("fp", "route", F.lit(bits).alias("bits"))
        rest = BITS - bits
        if not rest:
            return reduce(DataFrame.unionAll, [*groups, here(routed)])
        sizes = F.element_at(F.array(*[F.lit(len(flips(rest, k))) for k in range(HALF + 1)]), F.col("left") + 1)
        crowded = written(
            routed.groupBy("route").agg(F.sum(sizes).alias("variants"))
            .where(F.col("variants") > MOST_VARIANTS).select("route"),
            "simhash-crowded",
        )
        if crowded.isEmpty():
            return reduce(DataFrame.unionAll, [*groups, here(routed)])
        groups.append(here(routed.join(crowded, "route", "left_anti")))
        more = min(MORE_BITS, rest)
        hot = routed.join(crowded, "route", "left_semi")
        routed = written(sent_on(hot, bits, more), "simhash-routes")
        bits += more


def links(distinct: DataFrame, count: int) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints that are near each other."""
    prefix_bits = max(
        LEAST_PREFIX_BITS,
        math.ceil(math.log2(max(1, count) * len(flips(BITS, HALF)) / VARIANTS_PER_PREFIX)),
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(rows["fp"].to_numpy(np.int64)).view(np.uint64)
        route, bits = int(rows["route"].iloc[0]) % (1 << BITS), int(rows["bits"].iloc[0])
        root = forest(*meetings(fps, route, bits), len(fps))
        moved = np.flatnonzero(root != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": signed[moved], "b": signed[root[moved]]})

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return bounded_routes(distinct, prefix_bits).groupBy("bits", "route").applyInPandas(compare, schema)


# ---- operator --------------------------------------------------------------------------------


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def classes(marked: DataFrame) -> DataFrame:
    """``fp`` and the ``root`` fingerprint of its component, for all fingerprints of ``marked``."""
    distinct = written(marked.select("fp").distinct(), "simhash-distinct")
    labels = smallest_labels(links(distinct, distinct.count()), "root")
    joined = distinct.join(labels, distinct["fp"] == labels["node"], "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``fingerprint`` and ``component_id`` (the smallest id reachable) of every document.

    Nulls: a null text has fingerprint zero like any text without words; a null id keeps its row,
    and counts for a component only if all ids there are null.  Repeated rows give repeated
    results.  An empty table gives an empty result.  Other columns are ignored.
    """
    marked = written(fingerprints(docs, id_column, text_column), "simhash")
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = written(least.join(classes(marked), "fp"), "simhash-classes")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_column), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, with its columns: the smallest id, then the smallest text hash.

    A null id comes last.  Rows that share id and text are one document, so one of them stays (the
    least by a hash of the whole row); columns may be of any type.
    """
    key = F.xxhash64(whole_text(text_column))
    name, mark = spare_name(docs, "text_key"), spare_name(docs, "first_id")
    source = docs.withColumn(name, key)
    prints = fingerprints(source, id_column, text_column, [name]).withColumnRenamed(name, "text_key")
    marked = written(prints, "simhash")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "text_key")
    least = marked.groupBy("fp").agg(F.min(place).alias("place"))
    first = (
        least.join(classes(marked), "fp").groupBy("root").agg(F.min("place").alias("place"))
        .select(F.col("place.id").alias(mark), F.col("place.text_key").alias("first_key"))
    )
    same = source[id_column].eqNullSafe(F.col(mark)) & (source[name] == F.col("first_key"))
    kept = source.join(first, same, "left_semi")
    again = marked.groupBy("id", "text_key").agg(F.count("*").alias("rows")).where("rows > 1")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # Any kind of column can be written as JSON; equal texts of a row are equal rows here.
    row = F.struct(*docs.columns)
    one = kept.groupBy(id_column, name).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(mark))
    return one.select(f"{mark}.*")
