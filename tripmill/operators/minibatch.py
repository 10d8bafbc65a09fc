"""Mini-batch K-Means: every update takes a batch of exactly the size asked for.

Updates are sequential within a chain, and chains run in parallel, in a fixed number of rounds.  All
chains of a round begin with the same centers.  A center is the mean of what was assigned to it, so
the sums of all chains join into the centers of the next round without loss.  Rows are dealt to
chains and rounds by a hash, and numbered there; what is left of a chain below one batch is
dealt again, to fewer chains, until a single chain takes the rest.  A pass thus makes
ceil(rows / batch) updates, of which only the very last may be smaller.

All starts of a fit are followed through the same jobs, and so are fits of other batch sizes or of
nested prefixes of the rows.  The driver holds centers and their weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Hashable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.functions.priority import PRIORITY_BITS, hash_priority, unit_interval
from tripmill.operators.kmeans import (
    BATCH_CELLS,
    BLOCK_ROWS,
    DRIVER_SUM_ROWS,
    LEVEL,
    Fit,
    cluster_sums,
    distinct_centers,
    drawn_starts,
    packed,
    to_matrix,
    unpack,
)
from tripmill.schema import SEED
from tripmill.session import KEPT, bounded_batches

# Estimator settings.
BATCH_ROWS = 1_000
STREAM_BLOCK_ROWS = 10_000
RESTARTS = 10
# A fit without a stated number of passes ends when a pass lowers the error per row by less.
LEAST_GAIN = 3e-4
MOST_PASSES = 20
# Part of a center's weight that stays when another pass begins.
CARRIED_WEIGHT = 0.25
# A start this much worse than the best after a pass is not followed on.
HOPELESS = 1.02
ROUNDS = 4
# A chain has at least so many batches in a round; tables of millions of rows have longer ones.
CHAIN_BATCHES = 4
MOST_CHAINS = 8
CHAIN_ROWS = 2_000_000
# Rounds of a chain share a table while a task sorts and keeps about so many rows; else tables have fewer
# rounds, down to one.
TASK_ROWS = 1_000_000
# Rows are dealt independently of the samples the points may come from.
BLOCK_SEED = 7


@dataclass(frozen=True)
class Run:
    """One fit: how many rows it has, its batches, its passes (None: while they help), its level."""

    rows: int
    batch_rows: int = BATCH_ROWS
    passes: int | None = None
    level: int = 0


def update_centers(
    centers: np.ndarray, weights: np.ndarray, counts: np.ndarray, sums: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Running mean of everything assigned so far: each center weighs its past rows."""
    total = weights + counts
    moved = centers.copy()
    hit = counts > 0
    moved[hit] = (centers[hit] * weights[hit, None] + sums[hit]) / total[hit, None]
    return moved, total


def chains_of(rows: int, batch_rows: int) -> int:
    """Chains of a table; a table too small for two is one chain in one round."""
    chains = rows // (ROUNDS * CHAIN_BATCHES * batch_rows)
    return 1 if chains < 2 else min(chains, max(MOST_CHAINS, rows // (ROUNDS * CHAIN_ROWS)))


class _Batches:
    """Cuts sorted rows (run, chain, round, priority, coordinates) into batches as they come.

    Rows of whole batches are marked, or ``packed``: then some batches become one row with the bytes
    of their coordinates.  What a chain's round has left below a batch stays behind as rows, unless
    the chain is its run's only one.
    """

    def __init__(self, batch_rows: Sequence[int], alone: Sequence[bool], packed: bool):
        self.batch_rows, self.alone, self.packed = list(batch_rows), list(alone), packed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell, rows = None, 0

        def some(part: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
            if not part.num_rows:
                return
            if whole and self.packed:
                first = part.slice(0, 1)
                x = np.concatenate([
                    to_matrix(pa.RecordBatch.from_arrays(b.columns[4:], b.schema.names[4:]), self.width(b))
                    for b in part.to_batches()
                ])
                columns = [c.combine_chunks() for c in first.columns[:3]]
                columns += [pa.nulls(1, field.type) for field in list(first.schema)[3:]]
                columns += [pa.array([True]), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                return
            for batch in part.to_batches():
                columns = [*batch.columns, pa.array(np.full(batch.num_rows, whole))]
                if self.packed:
                    columns.append(pa.nulls(batch.num_rows, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                run = table.column(0)[0].as_py()
                cut = rows if self.alone[run] else rows - rows % self.batch_rows[run]
                yield from some(table.slice(0, cut), True)
                yield from some(table.slice(cut), False)
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            names = [*batch.schema.names, "whole", *["points"] * self.packed]
            runs, chains, rounds = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            changed = (np.diff(chains) != 0) | (np.diff(rounds) != 0)
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(runs)]
            for begin, end in zip(edges, edges[1:]):
                if cell != (chains[begin], rounds[begin]):
                    yield from ended()
                    cell, rows = (chains[begin], rounds[begin]), 0
                size = self.batch_rows[runs[begin]]
                most = size * max(1, BLOCK_ROWS // size)
                while begin < end:
                    part = batch.slice(begin, min(end - begin, most - rows))
                    held.append(part)
                    rows += part.num_rows
                    begin += part.num_rows
                    if rows == most:
                        yield from some(pa.Table.from_batches(held), True)
                        held.clear()
                        rows = 0
        yield from ended()

    @staticmethod
    def width(batch: pa.RecordBatch) -> int:
        column = batch.column(4)
        lists = batch.num_columns == 5 and pa.types.is_nested(column.type)
        return len(column.flatten()) // batch.num_rows if lists else batch.num_columns - 4


def dealt(points: DataFrame, runs: Sequence[Run], pack: bool = False) -> list[tuple[DataFrame, int]]:
    """Tables (run, chain, round, whole, coordinates) sorted by round and chain, each with its rounds.

    ``points`` has a level, a priority and the coordinates.  In all but the last table the whole rows of
    each (run, chain, round) are a multiple of the run's batch; the other rows are in later tables.
    Long chains have their rounds in several tables one after another, so a task holds a bounded number
    of rows at any table size; ``round`` counts from 0 in each.
    Packed tables hold the whole rows in blocks of one or more batches, as bytes in ``points``.
    """
    names = ["run", "chain", "round", "priority", *[c for c in points.columns if c not in (LEVEL, "priority")]]
    entries = [
        F.when(F.col(LEVEL) <= run.level, F.lit(i)) for i, run in enumerate(runs)
    ]
    left = points.withColumn("run", F.explode(F.filter(F.array(*entries), lambda i: i.isNotNull()))).drop(LEVEL)
    rows = [run.rows for run in runs]
    tables: list[tuple[DataFrame, int]] = []
    deals = 0
    while any(rows):
        chains = [chains_of(n, run.batch_rows) if n else 0 for n, run in zip(rows, runs)]
        # What is dealt again is few rows, so one round takes it.
        rounds = [ROUNDS if n > 1 and not deals else 1 for n in chains]
        first = np.cumsum([0, *chains]).tolist()

        def of_run(values: Sequence[int]):
            return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("run") + 1)

        turn = hash_priority(F.col("priority"), BLOCK_SEED + deals)
        cell = F.floor(unit_interval(F.col("turn")) * of_run([c * r for c, r in zip(chains, rounds)]))
        own = of_run([max(1, c) for c in chains])
        placed = left.withColumn("turn", turn).withColumns(
            {"chain": (of_run(first) + cell % own).cast("int"), "round": F.floor(cell / own).cast("int")}
        )
        cut = _Batches([run.batch_rows for run in runs], [n == 1 for n in chains], pack)
        every = max(rounds)
        longest = max(n // (c * r) for n, c, r in zip(rows, chains, rounds) if c)
        together = max(1, min(every, TASK_ROWS // max(1, longest)))
        over, behind = Counter(), []
        for begin in range(0, every, together):
            end = min(every, begin + together)
            some = placed
            if together < every:
                some = placed.where(F.col("round").between(begin, end - 1))
                some = some.withColumn("round", F.col("round") - begin)
            # Rounds come first, so a round is one run of the cached rows of a task.
            ordered = (
                some.repartitionById(first[-1], F.col("chain"))
                # A partition is one chain, and one number orders it: rounds, then turns (52 bits).
                .sortWithinPartitions(F.shiftleft(F.col("round").cast("bigint"), PRIORITY_BITS) + F.col("turn"))
                .select(*names)
            )
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in ordered.schema]).add("whole", "boolean")
            if pack:
                schema = schema.add("points", "binary")
            table = ordered.mapInArrow(cut, schema).persist(KEPT)
            rest = table.where(~F.col("whole"))
            counted = rest.groupBy("run").agg(F.count(F.lit(1)).alias("rows"))
            over.update({r["run"]: r["rows"] for r in counted.collect()})
            tables.append((table, end - begin))
            behind.append(rest.select("run", *names[3:]))
        rows = [over[i] for i in range(len(runs))]
        left = reduce(DataFrame.union, behind)
        deals += 1
    return tables


class _Chain:
    """The updates of one chain, for all models of its run at once."""

    def __init__(self, centers: np.ndarray, weights: np.ndarray, batch_rows: int):
        self.models, self.k, width = centers.shape
        self.begun, self.before = centers.reshape(-1, width), weights.reshape(-1)
        self.centers, self.batch_rows = self.begun, batch_rows
        self.counts, self.sums = np.zeros(len(self.begun)), np.zeros(self.begun.shape)
        self.errors = np.zeros(self.models)
        self.updates = self.largest = self.held = 0
        self.waiting: list[np.ndarray] = []

    def add(self, rows: np.ndarray) -> None:
        while len(rows):
            some = rows[: self.batch_rows - self.held]
            self.waiting.append(some)
            self.held += len(some)
            rows = rows[len(some) :]
            if self.held == self.batch_rows:
                self.update()

    def update(self) -> None:
        """Assign a batch with the centers as they are, then move them to their running means."""
        if not self.held:
            return
        x = np.concatenate(self.waiting)
        norms = (self.centers * self.centers).sum(axis=1)[:, None]
        step = max(1, BATCH_CELLS // len(self.centers))
        for begin in range(0, len(x), step):
            some = x[begin : begin + step]
            near = (norms - 2 * (self.centers @ some.T)).reshape(self.models, self.k, len(some))
            least, labels = near[:, 0].copy(), np.zeros((self.models, len(some)), np.int32)
            for j in range(1, self.k):
                np.copyto(labels, j, where=near[:, j] < least)
                np.minimum(least, near[:, j], out=least)
            self.errors += np.maximum(least + np.einsum("ij,ij->i", some, some), 0).sum(axis=1)
            member = labels[:, None, :] == np.arange(self.k)[:, None]
            member = member.reshape(len(self.centers), -1).astype("float64")
            self.counts += member.sum(axis=1)
            self.sums += member @ some
        self.centers, _ = update_centers(self.begun, self.before, self.counts, self.sums)
        self.updates += 1
        self.largest = max(self.largest, self.held)
        self.waiting, self.held = [], 0


class _Updates:
    """Per-task chains: rows arrive by chain, sums per model and cluster leave at its end."""

    def __init__(self, models: Mapping[int, tuple[np.ndarray, np.ndarray]], batch_rows: Mapping[int, int]):
        self.models, self.batch_rows = dict(models), dict(batch_rows)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, now, run = None, None, None
        width = next(iter(self.models.values()))[0].shape[2]

        def ended() -> Iterator[pa.RecordBatch]:
            if chain is None:
                return
            chain.update()
            total = chain.models * chain.k
            first = np.arange(total) % chain.k == 0
            model = np.arange(total) // chain.k
            columns = [
                pa.array(np.full(total, run), pa.int32()),
                pa.array(model, pa.int32()),
                pa.array(np.arange(total) % chain.k, pa.int32()),
                pa.array(chain.counts.astype("int64")),
                pa.array(np.where(first, chain.errors[model], 0.0)),
                pa.array(np.where(first, chain.updates, 0)),
                pa.array(np.where(first, chain.largest, 0)),
                *[pa.array(chain.sums[:, axis]) for axis in range(width)],
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

        names = ["run", "model", "cluster", "rows", "error", "updates", "largest"]
        names += [f"s{axis}" for axis in range(width)]
        for batch in batches:
            for numbers in zip(*batch.columns):
                i, own = numbers[0].as_py(), numbers[1].as_py()
                if now != own:
                    yield from ended()
                    now, run = own, i
                    chain = _Chain(*self.models[run], self.batch_rows[run])
                chain.add(unpack(numbers[2]).reshape(-1, width))
        yield from ended()


class _Followed:
    """The models of a run that are still followed, and what its passes have shown."""

    def __init__(self, run: Run, starts: Sequence[np.ndarray]):
        self.run, self.centers = run, np.stack(list(starts))
        self.weights = np.zeros(self.centers.shape[:2])
        self.best, self.passes, self.updates, self.largest = math.inf, 0, 0, 0
        self.errors = np.zeros(len(self.centers))

    @property
    def open(self) -> bool:
        return self.passes < (MOST_PASSES if self.run.passes is None else self.run.passes)

    def join(self, counts: np.ndarray, sums: np.ndarray) -> None:
        for i in range(len(self.centers)):
            self.centers[i], self.weights[i] = update_centers(self.centers[i], self.weights[i], counts[i], sums[i])

    def end_pass(self) -> None:
        error = float(self.errors.min())
        self.passes += 1
        gained = error < self.best * (1 - LEAST_GAIN)
        self.best = min(self.best, error)
        if self.run.passes is None and not gained:
            self.run = Run(self.run.rows, self.run.batch_rows, self.passes, self.run.level)
        good = self.errors <= HOPELESS * error
        self.centers, self.weights = self.centers[good], self.weights[good] * CARRIED_WEIGHT
        self.errors = np.zeros(len(self.centers))


def fit_runs(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    runs: Mapping[Hashable, Run],
    starts: Mapping[Hashable, Sequence[np.ndarray]],
    blocks: DataFrame | None = None,
) -> dict[Hashable, Fit]:
    """All runs through the same jobs; each gives its best start.

    Where runs have levels the table has a ``level`` column, and a run reads rows up to its own.
    ``blocks`` are the same rows packed, if the caller has them.
    """
    bounded_batches(df.sparkSession)
    names = list(runs)
    level = F.col(LEVEL) if LEVEL in df.columns else F.lit(0)
    points = df.select(level.alias(LEVEL), hash_priority(F.col(key), BLOCK_SEED).alias("priority"), *columns)
    tables = dealt(points, list(runs.values()), pack=True)
    followed = [_Followed(runs[name], starts[name]) for name in names]
    schema = "run int, model int, cluster int, rows bigint, error double, updates bigint, largest bigint"
    width = followed[0].centers.shape[2]
    axes = [f"s{axis}" for axis in range(width)]
    schema += "".join(f", {axis} double" for axis in axes)
    while any(f.open for f in followed):
        for table, rounds in tables:
            tasks = table.rdd.getNumPartitions()
            for number in range(rounds):
                now = {i: (f.centers, f.weights) for i, f in enumerate(followed) if f.open}
                step = _Updates(now, {i: followed[i].run.batch_rows for i in now})
                part = table.where((F.col("round") == number) & F.col("whole") & F.col("run").isin(list(now)))
                found = part.select("run", "chain", "points").mapInArrow(step, schema)
                if tasks * sum(c.shape[0] * c.shape[1] for c, _ in now.values()) > DRIVER_SUM_ROWS:
                    found = found.groupBy("run", "model", "cluster").agg(
                        F.max("largest").alias("largest"),
                        *[F.sum(name).alias(name) for name in ("rows", "error", "updates", *axes)],
                    )
                counts = {i: np.zeros(c.shape[:2]) for i, (c, _) in now.items()}
                sums = {i: np.zeros(c.shape) for i, (c, _) in now.items()}
                for row in found.collect():
                    i, at = row["run"], (row["model"], row["cluster"])
                    counts[i][at] += row["rows"]
                    sums[i][at] += [row[axis] for axis in axes]
                    followed[i].errors[at[0]] += row["error"]
                    followed[i].updates += row["updates"] if at == (0, 0) else 0
                    followed[i].largest = max(followed[i].largest, row["largest"])
                for i in now:
                    followed[i].join(counts[i], sums[i])
        for f in followed:
            if f.open:
                f.end_pass()
    for table, _ in tables:
        table.unpersist()
    leveled = LEVEL in df.columns
    if blocks is None:
        blocks = packed(df, columns, None, leveled)
    return dict(zip(names, _scored(blocks, leveled, followed)))


def _scored(blocks: DataFrame, leveled: bool, followed: Sequence[_Followed]) -> list[Fit]:
    """Sizes and error of the final centers over all rows of their runs, the best of each."""
    owners = [i for i, f in enumerate(followed) for _ in f.centers]
    centers = dict(enumerate(c for f in followed for c in f.centers))
    limits = {n: followed[i].run.level for n, i in enumerate(owners)} if leveled else None
    summed = cluster_sums(blocks, centers, None, max(f.run.rows for f in followed), limits)
    best: dict[int, Fit] = {}
    for n, (counts, _, errors) in summed.items():
        f, error = followed[owners[n]], float(errors.sum())
        if owners[n] not in best or error < best[owners[n]].inertia:
            best[owners[n]] = Fit(
                centers[n], error, int(counts.sum()), f.updates, counts.tolist(), f.passes, f.largest
            )
    return [best[i] for i in range(len(followed))]


def fit_minibatch(
    df: DataFrame,
    columns: Sequence[str],
    k: int,
    key: str,
    rows: int,
    batch_rows: int = BATCH_ROWS,
    seed: int = SEED,
    restarts: int = RESTARTS,
    passes: int | None = None,
) -> Fit:
    """Updates of ``batch_rows`` rows each, counted in ``iterations``.

    Passes over all rows end when one no longer lowers the error, unless their number is given.
    """
    blocks = packed(df, columns, key, LEVEL in df.columns).persist(KEPT)
    try:
        starts = drawn_starts(blocks, columns, key, {k: (k, seed, restarts)})[k]
        run = {k: Run(rows, batch_rows, passes)}
        return fit_runs(df, columns, key, run, {k: distinct_centers(starts)}, blocks)[k]
    finally:
        blocks.unpersist()


def fit_one_pass(
    df: DataFrame,
    columns: Sequence[str],
    k: int,
    key: str,
    rows: int,
    block_rows: int = STREAM_BLOCK_ROWS,
    seed: int = SEED,
    restarts: int = RESTARTS,
) -> Fit:
    """Every row exactly once, in updates of ``block_rows`` rows."""
    return fit_minibatch(df, columns, k, key, rows, block_rows, seed, restarts, 1)
