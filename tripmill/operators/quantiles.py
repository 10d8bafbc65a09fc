"""Exact order statistics and quantiles without sorting or collecting a column.

``percentile`` keeps every distinct value of a group in one task, which is right for small
inputs only.  Beyond EXACT_ROWS the value range is narrowed instead.  The first scan gives bounds,
moments and a mergeable sketch of every column; large inputs start from the bracket the sketch gives.
The second scan counts what lies below and inside the brackets and, where few rows lie inside,
lists them at once; a bracket that these exact counts do not confirm is not used.  Tables that grow
keep the statistics of their parts (``column_statistics``) and merge them (``merged_statistics``), so
the first scan is spared.  Each further pass counts equal-width bins inside the current bracket (combined map-side) and keeps the bin that
holds the wanted rank.  A bracket is finished when it has one distinct value, so a value shared
by a third of all rows ends the search at once, or when few enough rows are left to list.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

EXACT_ROWS = 200_000
LISTED_ROWS = 20_000
BINS = 2048
# Larger columns start from a sketch; its rank error is below SKETCH_ERROR for this size.
SKETCH_ROWS = 200_000
SKETCH_SIZE = 8192
SKETCH_ERROR = 8e-4


@dataclass
class Rank:
    """A rank and the bracket it was narrowed to; one value is left when low equals high.

    ``below`` rows are smaller than the bracket, ``rows`` rows are inside it.
    """

    column: str
    rank: int
    low: float
    high: float
    below: int
    rows: int

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


def _count_bins(df: DataFrame, brackets: list[tuple[str, float, float]], bins: list[int]):
    """Rows per (bracket, bin); with bins = 0 every distinct value is its own bin."""
    # Most rows lie outside every bracket; they leave before any entry is built for them.
    inside = [F.col(column).between(F.lit(low), F.lit(high)) for column, low, high in brackets]
    pieces = []
    for number, (column, low, high) in enumerate(brackets):
        value = F.col(column)
        if bins[number] and high > low:
            width = (high - low) / bins[number]
            bin_ = F.least(F.floor((value - low) / F.lit(width)), F.lit(bins[number] - 1)).cast("double")
        else:
            bin_ = value
        pieces.append(
            F.when(
                inside[number],
                F.struct(
                    F.lit(number).alias("bracket"),
                    bin_.alias("bin"),
                    value.alias("value"),
                ),
            )
        )
    entries = F.explode(F.array_compact(F.array(*pieces))).alias("hit")
    found = df.filter(reduce(or_, inside)).select(entries).select("hit.*")
    counted = found.groupBy("bracket", "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    by_bracket: dict[int, list] = {}
    for row in counted.collect():
        by_bracket.setdefault(row["bracket"], []).append(row)
    return [sorted(by_bracket.get(i, []), key=lambda r: r["low"]) for i in range(len(brackets))]


def _narrow(df: DataFrame, searches: list[Rank]) -> None:
    """Advance every open search by one pass over the data."""
    chosen = [s for s in searches if s.low < s.high]
    brackets = list(dict.fromkeys(s.bracket for s in chosen))
    if not brackets:
        return
    rows = {s.bracket: s.rows for s in chosen}
    bins = [0 if rows[bracket] <= LISTED_ROWS else BINS for bracket in brackets]
    found = dict(zip(brackets, _count_bins(df, brackets, bins), strict=True))
    for search in chosen:
        _take(search, found[search.bracket])


def _take(search: Rank, pieces: list[Row]) -> None:
    """Move a search into the piece of its bracket that holds its rank."""
    for piece in pieces:
        if search.rank < search.below + piece["rows"]:
            search.low, search.high = piece["low"], piece["high"]
            search.rows = piece["rows"]
            break
        search.below += piece["rows"]


def _start_from_sketches(df: DataFrame, searches: list[Rank], known: Mapping[str, Row]) -> None:
    """One scan: what lies below and inside each sketched bracket, and the bracket's own bins."""
    spans = {}
    for s in searches:
        share = s.rank / max(1, s.rows - 1)
        spans[s.column, s.rank] = (max(share - 2 * SKETCH_ERROR, 0.0), min(share + 2 * SKETCH_ERROR, 1.0))
    names = list(dict.fromkeys(s.column for s in searches))
    edges = {n: sorted({q for (m, _), span in spans.items() if m == n for q in span}) for n in names}
    sketches = df.sparkSession.createDataFrame(
        [tuple(bytes(known[n]["sketch"]) for n in names)], ", ".join(f"s{i} binary" for i in range(len(names)))
    )
    row = sketches.select(
        *[
            F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(q) for q in edges[n]])).alias(f"s{i}")
            for i, n in enumerate(names)
        ]
    ).first()
    at = {(n, q): v for i, n in enumerate(names) for q, v in zip(edges[n], row[i], strict=True)}
    brackets = {key: (key[0], at[key[0], low], at[key[0], high]) for key, (low, high) in spans.items()}
    distinct = list(dict.fromkeys(brackets.values()))
    held = {s.column: s.rows for s in searches}
    bins = [0 if 8 * SKETCH_ERROR * held[n] <= LISTED_ROWS else BINS for n, _, _ in distinct]
    observation = Observation(f"brackets {uuid.uuid4().hex}")
    watched = df.observe(
        observation,
        *[F.count_if(F.col(n) < low).alias(f"b{i}") for i, (n, low, _) in enumerate(distinct)],
        *[
            F.count_if(F.col(n).between(low, high)).alias(f"r{i}")
            for i, (n, low, high) in enumerate(distinct)
        ],
    )
    pieces = _count_bins(watched, distinct, bins)
    if not any(pieces):
        # No bracket holds a row, so none can hold a rank (and an empty result has no metrics).
        return
    counts = observation.get
    for s in searches:
        bracket = brackets[s.column, s.rank]
        i = distinct.index(bracket)
        below, rows = counts[f"b{i}"], counts[f"r{i}"]
        if below <= s.rank < below + rows:
            _, s.low, s.high = bracket
            s.below, s.rows = below, rows
            _take(s, pieces[i])


def column_statistics(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """One row per column, in one scan: counts, bounds, moments and a mergeable sketch of its values."""
    parts = []
    for name in names:
        value = F.col(name).cast("double")
        parts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(name).alias("rows"),
                F.count_if(F.col(name).isNull()).alias("nulls"),
                F.min(value).alias("low"),
                F.max(value).alias("high"),
                F.avg(value).alias("mean"),
                (F.var_pop(value) * F.count(name)).alias("squares"),
                F.kll_sketch_agg_double(value, SKETCH_SIZE).alias("sketch"),
            ).alias(f"c{len(parts)}")
        )
    wide = df.agg(*parts)
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(parts))])))


def merged_statistics(parts: DataFrame) -> DataFrame:
    """The statistics of a table from those of its parts; no row of the parts is read again."""
    total, mean = F.sum("rows"), F.sum(F.col("mean") * F.col("rows")) / F.nullif(F.sum("rows"), F.lit(0))
    between = F.sum(F.col("rows") * F.col("mean") * F.col("mean")) - total * mean * mean
    return parts.groupBy("column").agg(
        total.alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        mean.alias("mean"),
        (F.sum("squares") + F.greatest(between, F.lit(0.0))).alias("squares"),
        F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"),
    )


def known_columns(statistics: DataFrame) -> dict[str, Row]:
    """The statistics by column: one row each, with a sketch of bounded size."""
    return {row["column"]: row for row in statistics.collect()}


def find_ranks(
    df: DataFrame,
    ranks: Mapping[str, Iterable[int]],
    known: Mapping[str, Row] | None = None,
) -> list[Rank]:
    """The value at each zero-based rank of each column (nulls are not counted)."""
    doubles = df.select(*[F.col(name).cast("double").alias(name) for name in ranks])
    known = known or known_columns(column_statistics(df, ranks))
    searches = []
    for name, wanted in ranks.items():
        low, high, rows = known[name]["low"], known[name]["high"], known[name]["rows"]
        for rank in wanted:
            if not 0 <= rank < rows:
                raise ValueError(f"{name} has {rows} values, no rank {rank}")
            searches.append(Rank(name, rank, low, high, 0, rows))
    large = [s for s in searches if s.rows > SKETCH_ROWS]
    if large:
        _start_from_sketches(doubles, large, known)
    while any(s.low < s.high for s in searches):
        _narrow(doubles, searches)
    return searches


def quantiles(
    df: DataFrame, wanted: Mapping[str, Iterable[float]], exact_rows: int = EXACT_ROWS,
    known: Mapping[str, Row] | None = None,
) -> dict[tuple[str, float], float | None]:
    """Quantiles by linear interpolation between neighbours, null for an all-null column."""
    wanted = {name: list(shares) for name, shares in wanted.items()}
    known = known or known_columns(column_statistics(df, wanted))
    counts = {name: known[name]["rows"] for name in wanted}
    found: dict[tuple[str, float], float | None] = {}
    small = [name for name in wanted if counts[name] <= exact_rows]
    if small:
        row = df.agg(
            *[F.percentile(F.col(name).cast("double"), wanted[name]).alias(name) for name in small]
        ).first()
        for name in small:
            values = row[name] or [None] * len(wanted[name])
            found.update({(name, q): v for q, v in zip(wanted[name], values, strict=True)})
    large = [name for name in wanted if name not in small]
    if large:
        places = {(n, q): (counts[n] - 1) * q for n in large for q in wanted[n]}
        ranks = {
            n: sorted({f(places[n, q]) for q in wanted[n] for f in (math.floor, math.ceil)})
            for n in large
        }
        values = {(r.column, r.rank): r.low for r in find_ranks(df, ranks, known)}
        for (name, q), place in places.items():
            low, high = values[name, math.floor(place)], values[name, math.ceil(place)]
            found[name, q] = low + (high - low) * (place - math.floor(place))
    return found
