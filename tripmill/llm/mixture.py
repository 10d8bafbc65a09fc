"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to).  The flow sends
token capacity from patterns to the quotas of their sources; a pattern's first use is free,
each repetition costs one more than the last, so nothing is repeated while unused text could
fill a quota.  Documents of a pattern are then taken in the order of a seeded hash until the
pattern's flow is reached: whole rounds for all of them, one more for the first ones, and
once more a few that fit into what is left.

The driver sees patterns only.  The place in the hash order comes from sums over 2^16 ranges of
the hash, and a running sum inside the one range where the flow ends.

Nulls: a null text has size 0, a null source is a source that comes last, a null id is an id
like any other.  Repeated rows are documents of their own, and share their place in the order.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.llm.common import WORD, spare_name, whole_text, written

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
SEED = 42
RANGE_BITS = 16
# Documents that fill what is left of a pattern's flow, one job each.
FITTED = 3
# Patterns and sources go through the driver; more than this is refused, not cut.
MOST_PATTERNS = 200_000


def water_fill(sizes: Sequence[float], weights: Sequence[float], most_times: int) -> list[float]:
    """Shares of the whole by weight; what exceeds a source's limit goes to the others."""
    targets = [0.0] * len(sizes)
    open_, rest = [k for k, size in enumerate(sizes) if size > 0], float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if rest * weights[k] / total > most_times * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = rest * weights[k] / total
            break
        for k in over:
            targets[k] = float(most_times * sizes[k])
        rest -= sum(targets[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return targets


def route(
    capacity: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float], times: int
) -> list[dict[int, float]]:
    """Flow from each pattern to each of its sources at the least cost of repetition.

    All cost lies on the arcs into the patterns, so augmenting round by round (first uses, then
    first repetitions, and so on) with rerouting inside a round is the cheapest flow.
    """
    flow: list[dict[int, float]] = [dict.fromkeys(own, 0.0) for own in members]
    holders: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        for s in own:
            holders.setdefault(s, []).append(p)
    open_quota = list(quota)
    for _ in range(times):
        supply = list(capacity)
        for p in range(len(capacity)):
            while supply[p] > 1e-9:
                path = augmenting_path(p, members, holders, flow, open_quota)
                if path is None:
                    break
                amount = min(supply[p], open_quota[path[-1]])
                for k in range(2, len(path), 2):
                    amount = min(amount, flow[path[k]][path[k - 1]])
                for k in range(0, len(path) - 1, 2):
                    flow[path[k]][path[k + 1]] += amount
                    if k:
                        flow[path[k]][path[k - 1]] -= amount
                supply[p] -= amount
                open_quota[path[-1]] -= amount
    return flow


def augmenting_path(start: int, members, holders, flow, open_quota) -> list[int] | None:
    """Pattern, source, pattern, ... source: a shortest way to a source with an open quota."""
    came: dict[int, tuple[int, int] | None] = {}
    from_pattern: dict[int, int | None] = {start: None}
    queue = deque([start])
    while queue:
        p = queue.popleft()
        for s in members[p]:
            if s in came:
                continue
            came[s] = (p, s)
            if open_quota[s] > 1e-9:
                path = [s]
                while True:
                    p = came[path[0]][0]
                    path.insert(0, p)
                    if from_pattern[p] is None:
                        return path
                    path.insert(0, from_pattern[p])
            for q in holders[s]:
                if q not in from_pattern and flow[q][s] > 1e-9:
                    from_pattern[q] = s
                    queue.append(q)
    return None


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def collected_patterns(sized: DataFrame) -> dict[str, int]:
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("size"))
    rows = totals.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    return {row["pattern"]: int(row["size"]) for row in rows}


def plan_flow(
    totals: Mapping[str, int], weights: Sequence[float], times: int
) -> tuple[list[tuple], list[tuple]]:
    """For each pattern its flow; for each source its size, target and what it receives."""
    patterns = sorted(totals)
    lists = [json.loads(p)["m"] for p in patterns]
    sources = sorted({s for own in lists for s in own}, key=lambda s: (s is None, s or ""))
    index = {s: k for k, s in enumerate(sources)}
    members = [[index[s] for s in own] for own in lists]
    sizes = [0] * len(sources)
    for pattern, own in zip(patterns, members):
        for s in own:
            sizes[s] += totals[pattern]
    share = [float(weights[k % len(weights)]) for k in range(len(sources))]
    targets = water_fill(sizes, share, times)
    flow = route([totals[p] for p in patterns], members, targets, times)
    routed = [(p, totals[p], float(sum(f.values()))) for p, f in zip(patterns, flow)]
    got = [sum(f.get(k, 0.0) for f in flow) for k in range(len(sources))]
    return routed, list(zip(sources, sizes, targets, got))


def order_of(id_column: str, text_column: str, seed: int) -> Column:
    """The seeded order of documents; rows of equal id and text share their place."""
    return F.xxhash64(F.col(id_column), F.xxhash64(whole_text(text_column)), F.lit(seed))


def pattern_of(memberships: Column) -> Column:
    """The set of sources as text: names in one order, null as JSON's null."""
    return F.to_json(F.struct(F.array_sort(F.array_distinct(memberships)).alias("m")))


def range_of(order: Column) -> Column:
    return F.shiftrightunsigned(order, 64 - RANGE_BITS)


def plan_mix(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, times: int = MOST_TIMES
) -> tuple[DataFrame, DataFrame]:
    """Where the flow of each pattern ends, and the table of sources.

    ``sized`` has ``size``, ``pattern`` and ``order``.  The first table has for each pattern the
    rounds that all its documents are taken, the hash range (``edge``) and the last place in it
    (``cut``) up to which they are taken once more, and the places of single ``picks`` after that.
    """
    spark = sized.sparkSession
    routed, sources = plan_flow(collected_patterns(sized), weights, times)
    rounds = [min(int(f // s), times) if s else 0 for _, s, f in routed]
    plan = spark.createDataFrame(
        pa.table(
            {
                "pattern": pa.array([p for p, _, _ in routed], pa.string()),
                "rounds": pa.array(rounds, pa.int32()),
                "rest": pa.array([f - n * s for n, (_, s, f) in zip(rounds, routed)], pa.float64()),
            }
        )
    )
    table = spark.createDataFrame(
        pa.table(
            {
                "source": pa.array([row[0] for row in sources], pa.string()),
                "source_size": pa.array([row[1] for row in sources], pa.int64()),
                "target": pa.array([row[2] for row in sources], pa.float64()),
                "routed": pa.array([row[3] for row in sources], pa.float64()),
            }
        )
    )
    sums = sized.groupBy("pattern", range_of(F.col("order")).alias("range")).agg(
        F.sum("size").alias("range_size")
    )
    earlier = Window.partitionBy("pattern").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("range_size").over(earlier), F.lit(0))
    # The range where a pattern's flow ends: at most one for each pattern.
    edge = (
        sums.withColumn("before", before)
        .join(F.broadcast(plan), "pattern")
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("range_size") >= F.col("rest")))
        .select("pattern", F.col("range").alias("edge"), "before", "rest")
    )
    inside = (
        Window.partitionBy("pattern").orderBy("order", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cut = (
        sized.join(F.broadcast(edge), "pattern")
        .where(range_of(F.col("order")) == F.col("edge"))
        .withColumn("upto", F.col("before") + F.sum("size").over(inside))
        .where(F.col("upto") <= F.col("rest"))
        .groupBy("pattern").agg(F.max("order").alias("cut"), F.max("upto").alias("upto"))
    )
    limits = written(
        plan.join(edge.drop("rest"), "pattern", "left").join(cut, "pattern", "left")
        .withColumn("left", F.col("rest") - F.coalesce("upto", "before"))
        .select("pattern", "rounds", "edge", "cut", "left",
                F.array().cast("array<bigint>").alias("picks")),
        "mix-ends",
    )
    # What the next document would overshoot is filled by the later ones that come nearest to it.
    miss = F.abs(F.col("size") - F.col("left"))
    for _ in range(FITTED):
        fit = (
            sized.join(F.broadcast(limits.where("left >= 1")), "pattern")
            .where(~is_further(F.col("order")) & (miss < F.col("left")))
            .groupBy("pattern").agg(F.min(F.struct(miss.alias("miss"), "order", "size")).alias("fit"))
        )
        limits = written(
            limits.join(fit, "pattern", "left").select(
                "pattern", "rounds", "edge", "cut",
                (F.col("left") - F.coalesce("fit.size", F.lit(0))).alias("left"),
                F.when(F.col("fit").isNull(), F.col("picks"))
                .otherwise(F.array_append("picks", F.col("fit.order"))).alias("picks"),
            ),
            "mix-limits",
        )
    return limits.drop("left"), table


def is_further(order: Column) -> Column:
    """Whether a document lies before the place where its pattern's flow ends, or was picked."""
    here = range_of(order)
    within = (here < F.col("edge")) | ((here == F.col("edge")) & (order <= F.col("cut")))
    return F.coalesce(within, F.lit(False)) | F.array_contains("picks", order)


def times_taken(order: Column) -> Column:
    """How often a document is taken, next to the limits of its pattern."""
    return F.col("rounds") + is_further(order).cast("int")


def sized_rows(docs: DataFrame, memberships: Column, id_column: str, text_column: str, seed: int):
    return written(
        docs.select(
            F.col(id_column).alias("id"),
            words_in(whole_text(text_column)).alias("size"),
            pattern_of(memberships).alias("pattern"),
            order_of(id_column, text_column, seed).alias("order"),
        ),
        "mix-rows",
    )


def mix(
    docs: DataFrame,
    memberships: Column,
    weights: Sequence[float] = WEIGHTS,
    times: int = MOST_TIMES,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``id``, ``size``, ``pattern`` and ``taken`` words of every document; the table of sources.

    ``memberships`` is an array of source names; ``taken`` is ``size`` up to ``times`` times.
    """
    sized = sized_rows(docs, memberships, id_column, text_column, seed)
    limits, table = plan_mix(sized, weights, times)
    # A row per pattern, and their number has been checked.
    taken = sized.join(F.broadcast(limits), "pattern").select(
        "id", "size", "pattern", (F.col("size") * times_taken(F.col("order"))).alias("taken")
    )
    return taken, table


def mixed(
    docs: DataFrame,
    memberships: Column,
    weights: Sequence[float] = WEIGHTS,
    times: int = MOST_TIMES,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The mix itself: each document with its columns, as often as it is taken."""
    limits, _ = plan_mix(sized_rows(docs, memberships, id_column, text_column, seed), weights, times)
    row = spare_name(docs, "row_kept")
    has_words = F.coalesce(F.col(text_column).rlike(WORD), F.lit(False))
    held = docs.where(has_words).select(
        F.struct(*[F.col(c) for c in docs.columns]).alias(row),
        pattern_of(memberships).alias("mix_pattern"),
        order_of(id_column, text_column, seed).alias("mix_order"),
    )
    ends = F.broadcast(limits.withColumnRenamed("pattern", "mix_pattern"))
    often = held.join(ends, "mix_pattern").select(row, times_taken(F.col("mix_order")).alias("mix_times"))
    repeated = F.explode(F.sequence(F.lit(1), F.col("mix_times")))
    return often.where("mix_times > 0").select(row, repeated.alias("mix_time")).select(f"{row}.*")


def source_pattern(source: Column) -> Column:
    """The pattern of a document with this one source."""
    return pattern_of(F.array(source.cast("string")))


def mix_by_source(
    docs: DataFrame, source_column: str = "source", id_column: str = "doc_id", **options
) -> DataFrame:
    """Id, ``size``, ``source_size``, ``target`` and ``taken`` where a document has one source."""
    memberships = F.array(F.col(source_column).cast("string"))
    taken, table = mix(docs, memberships, id_column=id_column, **options)
    sources = table.withColumn("pattern", source_pattern(F.col("source")))
    return taken.join(F.broadcast(sources), "pattern").select(
        F.col("id").alias(id_column), "size", "source_size", "target", "taken"
    )
