"""K-Means by relational Lloyd steps.

One pass over the points serves every model still being fitted: all restarts, seeds and
candidate K share the scan.  Tasks reduce their rows to per-cluster sums, Spark adds those
up, and only the sums (models x clusters x dimensions) reach the driver.  Centers travel in
the task closure, so the plan never grows from step to step.

Points are packed once into blocks of some thousand rows (``packed``), whose numbers lie side by
side as bytes: a pass then hands few large values to Python instead of every row, and skips the
blocks of levels that no model still reads.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.functions.geometry import MAX_LITERALS, distance_array, nearest_columns
from tripmill.functions.geometry import nearest_of, with_nearest
from tripmill.operators.sampling import spread
from tripmill.schema import SEED
from tripmill.session import KEPT, bounded_batches

# Estimator settings.
RESTARTS = 10
MAX_ITERATIONS = 300
TOLERANCE = 1e-4
# Starts are drawn from all rows in a few rounds; a round keeps about this many rows per cluster.
DRAWING_ROUNDS = 3
DRAWN_PER_CLUSTER = 2
# Steps a start is refined by on the weighted rows drawn for it, which saves passes, and the times
# this is tried for each start.
REFINING_STEPS = 50
TRIALS = 4
BATCH_CELLS = 2_000_000
# Distances looked at together: few enough to stay in a core's cache.
CACHED_CELLS = 60_000
# A block of packed points has about so many rows.
BLOCK_ROWS = 8_192
# Partial sums are added up on the driver only while they are this few rows; else by Spark.
DRIVER_SUM_ROWS = 20_000
# From this many rows on, small models are summed over unpacked rows by expressions inside the engine:
# compiling new centers into a plan costs more than a pass over few rows, and less than one over many.
EXPRESSION_ROWS = 3_000_000
# The column of tables that hold nested prefixes: the number of the smallest one a row belongs to.
LEVEL = "level"
# Points of small tables are spread over the cores; large tables already have many tasks.
SPREAD_ROWS = 5_000_000


@dataclass
class Fit:
    centers: np.ndarray
    inertia: float = float("inf")
    rows: int = 0
    iterations: int = 0
    sizes: list[int] = field(default_factory=list)
    # Of mini-batch fits: passes over the rows, and the rows of the largest update.
    passes: int = 0
    update_rows: int = 0

    @property
    def normalized_inertia(self) -> float:
        return self.inertia / self.rows


def lloyd_step(
    df: DataFrame, columns: Sequence[str], centers: np.ndarray, by: str = "cluster"
) -> DataFrame:
    """Assign every row, then average per cluster: one step in DataFrame terms."""
    labeled = with_nearest(df, columns, centers)
    return labeled.groupBy(by).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(name).alias(name) for name in columns]
    )


def to_matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of an Arrow batch as float64: either numeric columns or one list column."""
    if batch.num_columns == 1 and not pa.types.is_floating(batch.schema.field(0).type):
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        return values.astype("float64").reshape(-1, width)
    columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
    return np.column_stack(columns).astype("float64", copy=False)


def without_first(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:])


def by_level(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The levels in the first column, each with the places of its rows."""
    levels = batch.column(0).to_numpy(zero_copy_only=False)
    for level in np.unique(levels).tolist():
        yield level, np.flatnonzero(levels == level)


class _Pack:
    """Rows (level, key, coordinates) to blocks of one level."""

    def __init__(self, block_rows: int):
        self.block_rows = block_rows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(level: int) -> pa.RecordBatch:
            keys, x = (np.concatenate(part) for part in zip(*held.pop(level)))
            columns = [pa.array([level], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (keys, x)]]
            return pa.RecordBatch.from_arrays(columns, [LEVEL, "keys", "points"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            rest = without_first(without_first(batch))
            lists = rest.num_columns == 1 and not pa.types.is_floating(rest.schema.field(0).type)
            x = to_matrix(rest, len(rest.column(0).flatten()) // batch.num_rows if lists else rest.num_columns)
            for level, at in by_level(batch):
                own = held.setdefault(level, [])
                own.append((keys[at], x[at]))
                if sum(len(k) for k, _ in own) >= self.block_rows:
                    yield block(level)
        for level in list(held):
            yield block(level)


def packed(df: DataFrame, columns: Sequence[str], key: str | None = None, leveled: bool = False) -> DataFrame:
    """Points as blocks: the level, and the bytes of the rows' key hashes and coordinates.

    Read many times by a fit, so the caller persists it.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(
        (F.col(LEVEL) if leveled else F.lit(0)).cast("int").alias(LEVEL),
        (F.lit(0) if key is None else F.xxhash64(key)).cast("bigint").alias("keys"),
        *columns,
    )
    return rows.mapInArrow(_Pack(BLOCK_ROWS), f"{LEVEL} int, keys binary, points binary")


def is_packed(df: DataFrame) -> bool:
    return df.columns == [LEVEL, "keys", "points"]


def unpack(value: pa.Scalar, dtype: str = "float64") -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype)


def least_squares(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Squared distance of every row to the closest of the known rows, by products of matrices."""
    least = np.empty(len(x))
    step = max(256, CACHED_CELLS // len(known))
    for begin in range(0, len(x), step):
        some = x[begin : begin + step]
        near = (known * known).sum(axis=1)[:, None] - 2 * (known @ some.T)
        least[begin : begin + step] = near.min(axis=0) + np.einsum("ij,ij->i", some, some)
    return np.maximum(least, 0, out=least)


def seed_centers(
    points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator
) -> np.ndarray:
    """Spread-out centers: each next one drawn with odds by weight and squared distance."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    closest = np.full(len(points), np.inf)
    for _ in range(1, k):
        gaps = points - chosen[-1]
        closest = np.minimum(closest, (gaps * gaps).sum(axis=1))
        odds = closest * weights
        total = odds.sum()
        chosen.append(points[rng.choice(len(points), p=odds / total if total > 0 else None)])
    return np.array(chosen)


def refine(
    points: np.ndarray, weights: np.ndarray, centers: np.ndarray, steps: int = REFINING_STEPS
) -> np.ndarray:
    """Move centers to the weighted means of the drawn rows."""
    before = None
    for _ in range(steps):
        labels, _ = nearest_of(points, centers)
        if before is not None and np.array_equal(labels, before):
            break
        before = labels
        member = np.eye(len(centers))[labels] * weights[:, None]
        sizes = member.sum(axis=0)
        means = (member.T @ points) / np.maximum(sizes, 1e-300)[:, None]
        centers = np.where(sizes[:, None] > 0, means, centers)
    return centers


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number in (0, 1] for every key, another one for every salt."""
    x = keys.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype("float64") + 1) / float(1 << 53)


class _Draw:
    """One round for all starts: each row is kept with odds by its squared distance.

    ``known`` holds the rows kept so far for each start, ``odds`` what a squared distance is
    multiplied with, ``salts`` the numbers that tell the starts' draws apart, and ``limits``, if
    given, the last level of the rows that a start sees.
    """

    def __init__(
        self, known: Sequence[np.ndarray], odds: Sequence[float], salts: Sequence[int],
        limits: Sequence[int] | None = None,
    ):
        self.known, self.odds, self.salts = list(known), list(odds), list(salts)
        self.limits = None if limits is None else list(limits)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = np.zeros(len(self.known))
        starts: list[int] = []
        kept: list[list[float]] = []
        for batch in batches:
            for level, key_bytes, point_bytes in zip(*batch.columns):
                keys = unpack(key_bytes, "int64")
                x = unpack(point_bytes).reshape(len(keys), -1)
                before = None
                for i, (known, odds, salt) in enumerate(zip(self.known, self.odds, self.salts)):
                    if self.limits is not None and level.as_py() > self.limits[i]:
                        continue
                    # In the first round all starts know the same.
                    if before is None or not np.array_equal(before, known):
                        before, squares = known, least_squares(x, known)
                    costs[i] += squares.sum()
                    hit = _mixed(keys, salt) <= squares * odds
                    starts += [i] * int(hit.sum())
                    kept += x[hit].tolist()
        starts += range(len(costs))
        points = [*kept, *[None] * len(costs)]
        numbers = pa.array([None] * len(kept) + costs.tolist(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int32()), numbers, pa.array(points, pa.list_(pa.float64()))],
            ["start", "cost", "point"],
        )


def drawn_starts(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    wanted: Mapping[Hashable, tuple[int, int, int]],
    limits: Mapping[Hashable, int] | None = None,
) -> dict[Hashable, list[tuple[float, np.ndarray]]]:
    """Starting centers drawn from all rows, cheapest first, with their squared error over all rows.

    With ``limits`` the table holds nested prefixes, and a name sees the rows up to its level.

    ``wanted`` gives k, seed and restarts for each name.  Every round is one pass over the table
    for all starts together: a row is kept with odds by its squared distance to the rows kept
    before, so a small far cluster is found whatever the table's size.  The kept rows (a few per
    cluster) are weighted by the rows nearest to them, and the k centers come from those.
    """
    if not is_packed(df):
        blocks = packed(df, columns, key, limits is not None).persist(KEPT)
        try:
            return drawn_starts(blocks, columns, key, wanted, limits)
        finally:
            blocks.unpersist()
    points = df
    names = [name for name, (_, _, restarts) in wanted.items() for _ in range(restarts)]
    seen = None if limits is None else {i: limits[name] for i, name in enumerate(names)}
    turn = {name: 0 for name in wanted}
    sizes, salts = [], []
    for name in names:
        k, seed, _ = wanted[name]
        sizes.append(k)
        salts.append(seed * 1_000_003 + turn[name] * 101)
        turn[name] += 1
    first = points.first()
    width = 1 if first is None else len(first["points"]) // len(first["keys"])
    # Of every level once: rows and mean, and with it what all rows cost around their mean.
    edges = sorted({0} if limits is None else set(limits.values()))
    whole = cluster_sums(
        points, {i: np.zeros((1, width)) for i in range(len(edges))},
        limits=None if limits is None else dict(enumerate(edges)),
    )
    place = [0 if limits is None else edges.index(limits[name]) for name in names]
    counted = [int(whole[i][0][0]) for i in range(len(edges))]
    for name, (k, _, _) in wanted.items():
        found = counted[0 if limits is None else edges.index(limits[name])]
        if found < k:
            raise ValueError(f"{k} clusters need at least {k} rows, found {found}")
    rows = max(counted)
    means = [sums[0] / max(1, n) for n, (_, sums, _) in zip(counted, whole.values())]
    around = [
        max(0.0, float(errors[0] - n * mean @ mean))
        for n, mean, (_, _, errors) in zip(counted, means, whole.values())
    ]
    means = [means[i] for i in place]
    cost = [around[i] for i in place]
    known = [mean[None, :] for mean in means]
    found: list[np.ndarray | None] = [None] * len(names)
    tasks = points.rdd.getNumPartitions()
    for draw in range(DRAWING_ROUNDS):
        odds = [DRAWN_PER_CLUSTER * k / c if c > 0 else 0.0 for k, c in zip(sizes, cost)]
        drawn = points.mapInArrow(
            _Draw(known, odds, [s + 7 * draw for s in salts], None if seen is None else list(seen.values())),
            "start int, cost double, point array<double>",
        )
        if tasks * len(names) > DRIVER_SUM_ROWS:
            drawn = drawn.groupBy("start").agg(F.sum("cost").alias("cost"), F.collect_list("point").alias("points"))
            results = [(r["start"], r["cost"], r["points"]) for r in drawn.collect()]
        else:
            results = [(r["start"], r["cost"], [] if r["point"] is None else [r["point"]]) for r in drawn.collect()]
        summed, kept = np.zeros(len(names)), [[] for _ in names]
        for start, number, chosen in results:
            summed[start] += number or 0.0
            kept[start] += chosen
        for i, chosen in enumerate(kept):
            if draw:
                cost[i] = float(summed[i])
            if chosen:
                new = np.array(sorted(chosen), dtype="float64")
                found[i] = new if found[i] is None else np.concatenate([found[i], new])
                # The mean stays in sight, so costs fall from round to round and draws stay few.
                known[i] = np.concatenate([means[i][None, :], found[i]])
    # What all restarts of a name have drawn is one weighted sample of its rows.
    pools = {}
    for name in wanted:
        own = [i for i, owner in enumerate(names) if owner == name]
        drawn = [means[i][None, :] if found[i] is None else found[i] for i in own]
        if own:
            pools[own[0]] = np.unique(np.concatenate(drawn), axis=0)
    weighed = cluster_sums(points, pools, tasks, rows, seen and {i: seen[i] for i in pools})
    refined = {}
    pool = 0
    for i in range(len(names)):
        pool = i if i in pools else pool
        counts = weighed[pool][0].astype("float64")
        rng = np.random.default_rng(salts[i])
        trials = [refine(pools[pool], counts, seed_centers(pools[pool], counts, sizes[i], rng)) for _ in range(TRIALS)]
        best = min(trials, key=lambda c: float(nearest_of(pools[pool], c)[1] @ counts))
        # In an order of their own, so restarts that end in the same place are equal.
        refined[i] = best[np.lexsort(best.T[::-1])]
    # What a start costs is asked of all rows: its few drawn rows may miss a whole group.
    costs = {i: float(e.sum()) for i, (_, _, e) in cluster_sums(points, refined, tasks, rows, seen).items()}
    starts: dict[Hashable, list[tuple[float, np.ndarray]]] = {name: [] for name in wanted}
    for i, name in enumerate(names):
        starts[name].append((costs[i], refined[i]))
    return {name: sorted(found, key=lambda pair: pair[0]) for name, found in starts.items()}


def distinct_centers(starts: Sequence[tuple[float, np.ndarray]]) -> list[np.ndarray]:
    """Restarts that begin in the same place, up to rounding, need one fit."""
    found: dict[bytes, np.ndarray] = {}
    for _, centers in starts:
        found.setdefault((np.round(centers, 9) + 0.0).tobytes(), centers)
    return list(found.values())


class _ClusterSums:
    """Per-task reduction of points to (model, cluster) counts, sums and squared error."""

    def __init__(
        self, centers: Sequence[np.ndarray], numbers: Sequence[int], limits: Sequence[int] | None = None
    ):
        self.numbers, self.centers = list(numbers), list(centers)
        self.limits = None if limits is None else list(limits)
        self.edges = np.cumsum([0, *[len(c) for c in centers]])

    def seen(self, level: int):
        """Of the models that see a level: places of their clusters, each one's own, and their centers."""
        own = [i for i in range(len(self.centers)) if self.limits is None or self.limits[i] >= level]
        ends = np.cumsum([0, *[len(self.centers[i]) for i in own]]).tolist()
        at = np.concatenate([[], *[np.arange(self.edges[i], self.edges[i + 1]) for i in own]]).astype(int)
        return at, list(zip(ends, ends[1:])), np.vstack(self.centers)[at]

    def matrices(self, batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
        names = batch.schema.names
        if names == [LEVEL, "points"]:
            for level, points in zip(*batch.columns):
                yield level.as_py(), unpack(points).reshape(-1, width)
        elif self.limits is None:
            yield 0, to_matrix(batch, width)
        else:
            x = to_matrix(without_first(batch), width)
            for level, at in by_level(batch):
                yield level, x[at]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width = int(self.edges[-1]), self.centers[0].shape[1]
        counts, errors = np.zeros(total), np.zeros(total)
        sums = np.zeros((total, width))
        known: dict[int, tuple] = {}
        kinds = np.int16 if total < 1 << 15 else np.int64
        for batch in batches:
            for level, rows in self.matrices(batch, width):
                if level not in known:
                    known[level] = self.seen(level)
                at, models, centers = known[level]
                if not len(at):
                    continue
                norms = (centers * centers).sum(axis=1)[:, None]
                step = min(len(rows), max(256, CACHED_CELLS // len(at)))
                # Two tables for all parts: new ones would cost more than filling them.
                tables = np.empty((2, len(at), step))
                for begin in range(0, len(rows), step):
                    x = rows[begin : begin + step]
                    lengths = np.einsum("ij,ij->i", x, x)
                    near, member = tables[:, :, : len(x)]
                    np.matmul(-2 * centers, x.T, out=near)
                    near += norms
                    for low, high in models:
                        # The first of the closest centers has the row.
                        least, label = near[low].copy(), np.zeros(len(x), kinds)
                        for j in range(low + 1, high):
                            np.copyto(label, j - low, where=near[j] < least)
                            np.minimum(least, near[j], out=least)
                        for j in range(low, high):
                            member[j] = label == j - low
                        least += lengths
                        errors[at[low:high]] += member[low:high] @ np.maximum(least, 0, out=least)
                    counts[at] += member.sum(axis=1)
                    sums[at] += member @ x
        model = np.repeat(self.numbers, np.diff(self.edges))
        cluster = np.concatenate([np.arange(n) for n in np.diff(self.edges)])
        kept = counts > 0
        columns = [
            pa.array(model[kept], pa.int32()),
            pa.array(cluster[kept], pa.int32()),
            pa.array(counts[kept].astype("int64"), pa.int64()),
            pa.array(errors[kept], pa.float64()),
            *[pa.array(sums[kept, axis], pa.float64()) for axis in range(width)],
        ]
        names = ["model", "cluster", "rows", "error", *[f"s{axis}" for axis in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names)


def spread_points(points: DataFrame, rows: int) -> DataFrame:
    """A small table may sit in one file and so in one task; give every core a share."""
    return points if rows > SPREAD_ROWS else spread(points, rows)


def _sums_by_expression(
    points: DataFrame, centers: Mapping[int, np.ndarray], limits: Mapping[int, int] | None
) -> DataFrame:
    """Centers as literals: one nearest-center entry per row and model, summed by Spark."""
    names = [name for name in points.columns if limits is None or name != LEVEL]
    arrays = {f"__d{i}": distance_array(names, c) for i, c in centers.items()}
    entries = []
    for i in centers:
        cluster, smallest = nearest_columns(F.col(f"__d{i}"))
        entries.append(
            F.struct(F.lit(i).alias("model"), cluster.alias("cluster"), smallest.alias("error"),
                     F.lit(None if limits is None else limits[i]).cast("int").alias("limit"))
        )
    listed = F.array(*entries)
    if limits is not None:
        listed = F.filter(listed, lambda entry: entry["limit"] >= F.col(LEVEL))
    each = points.withColumns(arrays).select(*names, F.inline(listed)).drop("limit")
    return each.groupBy("model", "cluster").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("error").alias("error"),
        *[F.sum(name).alias(f"s{axis}") for axis, name in enumerate(names)],
    )


def _sums_by_batch(
    points: DataFrame, centers: Mapping[int, np.ndarray], tasks: int | None,
    limits: Mapping[int, int] | None,
) -> DataFrame:
    """Centers in the task closure: each task reduces its Arrow batches to cluster sums."""
    width = next(iter(centers.values())).shape[1]
    axes = [f"s{axis}" for axis in range(width)]
    schema = "model int, cluster int, rows bigint, error double, " + ", ".join(
        f"{axis} double" for axis in axes
    )
    sums_per_task = _ClusterSums(
        list(centers.values()), list(centers), None if limits is None else [limits[i] for i in centers]
    )
    partial = points.mapInArrow(sums_per_task, schema)
    if tasks is None or tasks * int(sums_per_task.edges[-1]) > DRIVER_SUM_ROWS:
        partial = partial.groupBy("model", "cluster").agg(
            *[F.sum(name).alias(name) for name in ("rows", "error", *axes)]
        )
    return partial


def cluster_sums(
    points: DataFrame,
    centers: Mapping[int, np.ndarray],
    tasks: int | None = None,
    rows: int = 0,
    limits: Mapping[int, int] | None = None,
) -> dict[int, tuple]:
    """Counts, sums and squared error of every cluster of every numbered model, in one job.

    ``tasks`` (partitions) and ``rows`` are given where the caller knows them.  ``points`` is packed, or
    has just the coordinates; with ``limits`` those follow the level of a nested prefix.  A model sees
    the rows up to its limit.
    """
    width = next(iter(centers.values())).shape[1]
    literals = sum(c.size for c in centers.values())
    coordinates = len(points.columns) - (limits is not None)
    if is_packed(points):
        if limits is not None:
            points = points.where(F.col(LEVEL) <= max(limits[i] for i in centers))
        summed = _sums_by_batch(points.select(LEVEL, "points"), centers, tasks, limits)
    elif rows >= EXPRESSION_ROWS and literals <= MAX_LITERALS and coordinates == width:
        summed = _sums_by_expression(points, centers, limits)
    else:
        summed = _sums_by_batch(points, centers, tasks, limits)
    found = {
        number: (np.zeros(len(c), dtype="int64"), np.zeros((len(c), width)), np.zeros(len(c)))
        for number, c in centers.items()
    }
    for row in summed.collect():
        counts, sums, errors = found[row["model"]]
        counts[row["cluster"]] += row["rows"]
        errors[row["cluster"]] += row["error"]
        sums[row["cluster"]] += [row[f"s{axis}"] for axis in range(width)]
    return found


def fit_many(
    points: DataFrame,
    starts: Mapping[Hashable, Sequence[np.ndarray]],
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    limits: Mapping[Hashable, int] | None = None,
) -> dict[Hashable, Fit]:
    """The best restart of every key; with ``limits``, over the key's own prefix of the rows.

    ``points`` is packed and persisted by the caller, as it is read once per step, or holds just the
    coordinates (with ``limits``, the level first).  They are standardized, so the tolerance is on
    their scale.
    """
    if not is_packed(points):
        names = [name for name in points.columns if limits is None or name != LEVEL]
        blocks = packed(points, names, None, limits is not None).persist(KEPT)
        try:
            return fit_many(blocks, starts, max_iterations, tolerance, limits)
        finally:
            blocks.unpersist()
    owners = [key for key, options in starts.items() for _ in options]
    centers = {i: c for i, c in enumerate(c for options in starts.values() for c in options)}
    fits = {i: Fit(c) for i, c in centers.items()}
    tasks, rows = points.rdd.getNumPartitions(), 0
    settled: set[int] = set()
    active = set(centers)
    for step in range(max_iterations + 1):
        current = {i: fits[i].centers for i in sorted(active)}
        seen = None if limits is None else {i: limits[owners[i]] for i in current}
        results = cluster_sums(points, current, tasks, rows, seen)
        for i, (counts, sums, errors) in results.items():
            fit = fits[i]
            fit.rows, fit.inertia = int(counts.sum()), float(errors.sum())
            rows = max(rows, fit.rows)
            fit.sizes = counts.tolist()
            if i in settled or step == max_iterations:
                active.discard(i)
                continue
            filled = counts > 0
            moved = fit.centers.copy()
            moved[filled] = sums[filled] / counts[filled, None]
            shift = float(((moved - fit.centers) ** 2).sum())
            fit.centers, fit.iterations = moved, step + 1
            if shift <= tolerance:
                settled.add(i)
        if not active:
            break
    best: dict[Hashable, Fit] = {}
    for i, key in enumerate(owners):
        if key not in best or fits[i].inertia < best[key].inertia:
            best[key] = fits[i]
    return best


def fit_kmeans(
    df: DataFrame,
    columns: Sequence[str],
    k: int,
    key: str,
    seed: int = SEED,
    restarts: int = RESTARTS,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> Fit:
    blocks = packed(df, columns, key).persist(KEPT)
    try:
        starts = drawn_starts(blocks, columns, key, {k: (k, seed, restarts)})
        return fit_many(blocks, {k: distinct_centers(starts[k])}, max_iterations, tolerance)[k]
    finally:
        blocks.unpersist()
