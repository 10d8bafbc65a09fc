"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other numbers has the same
template.  Windows of template tokens of all documents are hash-joined with the windows of the
benchmark.  Along an alignment each value of the item must then have one new value, the one that
most of its places have; windows that contradict it do not count, windows without a changed value
always do.  A document is contaminated by an item if the windows that count cover enough of it.

Every window also has a hash of its words without case, so a verbatim passage is found whatever
its slots are and however it is capitalised.  With other values an alignment needs some literal
tokens, so that runs of numbers or names match nothing.  Items shorter than a window are one
window of their own length.

Nulls: a null text has no tokens.  A null id is a value like any other; rows are told apart by
id and text.  Repeated rows and repeated items give one pair.  Empty tables give an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.llm.common import bounded_batches, slices, whole_text, worker_memory, written

WINDOW = 8
# Literals that the covered part of an alignment needs where values changed.  An item with fewer
# needs all of its own, if they are half of its tokens and not fewer than FEWEST_LITERALS.
LEAST_LITERALS = 5
FEWEST_LITERALS = 3
# Share of an item's windows, or tokens covered, from which it counts as contained.
COVERED_SHARE = 0.5
COVERED_TOKENS = 25
# Window hashes of the benchmark that may travel with the tasks (8 bytes each).  A larger
# benchmark is joined by a shuffle of all windows instead, with the same result.
CARRIED_HASHES = 2_000_000
REMEMBERED_TOKENS = 500_000
# Marks behind which a capital does not make a name; all of them read as MARK.
ENDS = ".!?:;\n\"“”«»()[]"
MARK = "."
WORD = re.compile(r"[^\W_]+")
# Units that stand behind a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yards mi mile miles g kg mg lb lbs oz ton tons "
    "ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h "
    "hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv j kj cal "
    "kcal kb mb gb tb pct percent degrees usd eur gbp dollar dollars euro euros cent cents".split()
)
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
KINDS = (NUMBER, NAME, UNIT)
# Classes of a token: its template also depends on its neighbours for the last two.
LITERAL, IS_NUMBER, IS_MARK, MAYBE_NAME, MAYBE_UNIT, MIXED = range(6)
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
KINDS = (NUMBER, NAME, UNIT)
ODD = np.uint64(0x9E3779B97F4A7C15)


def rough_tokens(text: str) -> list[str]:
    """Marks, and runs without white space, marks or commas."""
    for mark in ENDS:
        if mark in text:
            text = text.replace(mark, f" {MARK} ")
    return text.replace(",", " ").split()


def fine_tokens(rough: list[str]) -> list[str]:
    """Only marks and words: other characters end a word."""
    return [t for r in rough for t in ([r] if r == MARK else WORD.findall(r))]


def token_class(token: str) -> int:
    if token == MARK:
        return IS_MARK
    if not token.isalnum():
        return MIXED
    if token[0].isdigit():
        return IS_NUMBER
    if token[0].isupper() and token[1:].islower():
        return MAYBE_NAME
    return MAYBE_UNIT if token.lower() in UNITS else LITERAL


class Words(NamedTuple):
    """The words of several texts, one after another: ``word`` has their places among the tokens,
    ``first`` the first word of each text (and the end)."""

    tokens: list[str]
    word: np.ndarray
    text: np.ndarray
    first: np.ndarray
    plain: np.ndarray
    hashes: np.ndarray
    slot: np.ndarray


class TokenTable:
    """Class and literal hash of every token met, remembered up to a bound."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.kind = np.zeros(0, np.int8)
        self.hash = np.zeros(0, np.uint64)
        self.mixed: set[str] = set()

    def learn(self, tokens: set[str]) -> None:
        from xxhash import xxh64_intdigest

        fresh = list(tokens - self.code.keys())
        if len(self.code) + len(fresh) > REMEMBERED_TOKENS:
            self.clear()
            fresh = list(tokens)
        base = len(self.code)
        self.code.update((t, base + k) for k, t in enumerate(fresh))
        kinds = [token_class(t) for t in fresh]
        self.mixed.update(t for t, kind in zip(fresh, kinds) if kind == MIXED)
        self.kind = np.concatenate([self.kind, np.array(kinds, np.int8)])
        hashes = np.array([xxh64_intdigest(t.lower()) for t in fresh], np.uint64)
        self.hash = np.concatenate([self.hash, hashes])

    def tokens(self, texts: list[str]) -> list[list[str]]:
        """Marks and words of each text; all of them are known afterwards."""
        found = list(map(rough_tokens, texts))
        self.learn(set().union(*found))
        again = [k for k, rough in enumerate(found) if not self.mixed.isdisjoint(rough)]
        for k in again:
            found[k] = fine_tokens(found[k])
        # All of the batch at once: learning may have begun a new memory.
        self.learn(set().union(*found))
        return found

    def template(self, found: list[list[str]]) -> Words:
        """The words of all texts in ``found`` with their hashes and placeholders.

        A capitalised word is a name unless it stands at the start or behind a mark; a unit
        stands behind a number.
        """
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        tokens = list(chain.from_iterable(found))
        codes = np.fromiter(map(self.code.__getitem__, tokens), np.int64, len(tokens))
        kind = self.kind[codes]
        text = np.repeat(np.arange(len(found)), lengths)
        after_mark = np.ones(len(tokens), bool)
        after_mark[1:] = (kind[:-1] == IS_MARK) | (text[1:] != text[:-1])
        word = np.flatnonzero(kind != IS_MARK)
        kind, after_mark, text = kind[word], after_mark[word], text[word]
        after_number = np.zeros(len(word), bool)
        after_number[1:] = (kind[:-1] == IS_NUMBER) & (text[1:] == text[:-1])
        slot = np.full(len(word), -1, np.int8)
        slot[kind == IS_NUMBER] = 0
        slot[(kind == MAYBE_NAME) & ~after_mark] = 1
        slot[(kind == MAYBE_UNIT) & after_number] = 2
        plain = self.hash[codes[word]]
        first = np.searchsorted(text, np.arange(len(found) + 1))
        return Words(tokens, word, text, first, plain, np.where(slot < 0, plain, SLOT_HASHES[slot]), slot)


# Hashes of the placeholders; the last entry stands for the literals, which have their own.
SLOT_HASHES = np.array([11, 13, 17, 0], np.uint64) * ODD


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` tokens."""
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width if len(total) else 0):
        total = total * ODD + hashes[k : k + len(total)]
        total ^= total >> np.uint64(29)
    return total


def windows_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window inside one text: its place, template hash, verbatim hash and literals.

    Both hashes are the same where a window has no slots.
    """
    template, plain = window_hashes(words.hashes, width), window_hashes(words.plain, width)
    at = np.flatnonzero(words.text[: len(plain)] == words.text[width - 1 :])
    literals = np.concatenate([[0], np.cumsum(words.slot < 0)])
    return at, template[at], plain[at], literals[at + width] - literals[at]


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values the sorted array has."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[place] == values


def windows(
    source_table: DataFrame, key_columns: list[str], text_column: str, widths: list[int],
    wanted: np.ndarray | None, own_width: bool,
) -> DataFrame:
    """Rows for the (wanted) windows by template and verbatim, with their keys.

    ``h`` and ``shape`` are to be equal, ``at`` is the place in the text, ``mask`` has a bit for
    every literal, ``slots`` the values of the others.  ``n_windows`` counts the windows of the
    text, ``n_template`` those that other values may match, and ``least`` the literals asked for.
    ``own_width`` is for items: the window, or the whole item if it is shorter.
    """
    bounded_batches(source_table.sparkSession)
    source = source_table.select(*key_columns, whole_text(text_column).alias("text"))
    out = [("h", pa.int64()), ("at", pa.int32()), ("n_windows", pa.int32()), ("n_template", pa.int32()),
           ("least", pa.int32()), ("mask", pa.int32()), ("shape", pa.string()),
           ("slots", pa.list_(pa.string()))]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_memory("template-tokens", TokenTable)
        for whole in batches:
            for batch in slices(whole):
                rows, columns = [], [[] for _ in out]
                words = table.template(table.tokens(batch.column(len(key_columns)).to_pylist()))
                sizes = np.diff(words.first)
                literal = np.bincount(words.text[words.slot < 0], minlength=len(sizes))
                # Texts whose literals are enough to tell them with other values in their slots.
                telling = (literal >= LEAST_LITERALS) | (
                    (literal >= FEWEST_LITERALS) & (2 * literal >= sizes)
                )
                own = np.minimum(sizes, WINDOW)
                for width in sorted(set(own[own > 0].tolist())) if own_width else widths:
                    at, template, plain, literals = windows_of(words, width)
                    text = words.text[at]
                    able = literals > 0
                    if own_width:
                        able &= telling[text]
                    n_windows = np.bincount(text, minlength=len(sizes))
                    n_template = np.bincount(text[able], minlength=len(sizes))
                    hits = []
                    for found, verbatim in ((template, False), (plain, True)):
                        # A window without slots is the same either way, and stands for both.
                        here = np.ones(len(at), bool) if verbatim else able & (literals < width)
                        if own_width:
                            here &= own[text] == width
                        if wanted is not None:
                            here &= among(found, wanted)
                        hits += [(k, int(found[k : k + 1].view(np.int64)[0]), verbatim)
                                 for k in np.flatnonzero(here).tolist()]
                    for k, h, verbatim in hits:
                        place, row = int(at[k]), int(text[k])
                        tokens = [words.tokens[w].lower() for w in words.word[place : place + width]]
                        kinds = [-1] * width if verbatim else words.slot[place : place + width].tolist()
                        rows.append(row)
                        values = (
                            h, place - int(words.first[row]), n_windows[row], n_template[row],
                            min(LEAST_LITERALS, literal[row]),
                            sum(1 << j for j, kind in enumerate(kinds) if kind < 0),
                            " ".join(t if kind < 0 else KINDS[kind] for t, kind in zip(tokens, kinds)),
                            [f"{KINDS[kind]} {t}" for t, kind in zip(tokens, kinds) if kind >= 0],
                        )
                        for column, value in zip(columns, values):
                            column.append(value)
                keys = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(key_columns))]
                arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, out)]
                yield pa.RecordBatch.from_arrays(keys + arrays, names=key_columns + [n for n, _ in out])

    whole_numbers = ("at", "n_windows", "n_template", "least", "mask")
    schema = T.StructType(
        [source.schema[k] for k in key_columns]
        + [T.StructField("h", T.LongType())]
        + [T.StructField(name, T.IntegerType()) for name in whole_numbers]
        + [T.StructField("shape", T.StringType()), T.StructField("slots", T.ArrayType(T.StringType()))]
    )
    return source.mapInArrow(compute, schema)


def slot_pairs(window: dict) -> list[tuple[int, str, str]]:
    """Place in the item, the item's value and the document's of every slot of a window."""
    offsets = [j for j in range(window["width"]) if not window["mask"] >> j & 1]
    return [(window["at"] + j, s["i"], s["o"]) for j, s in zip(offsets, window["slots"])]


def judged(matched: list[dict], least: int) -> tuple[list[int], bool]:
    """Places of the windows of an alignment that count, and whether any has other values."""
    pairs = [slot_pairs(window) for window in matched]
    votes: dict[str, Counter] = {}
    for _, i, o in {pair for own in pairs for pair in own}:
        votes.setdefault(i, Counter())[o] += 1
    # Without more places than any other, no new value is the value's.
    new = {i: o for i, (o, times) in ((i, v.most_common(1)[0]) for i, v in votes.items())
           if list(votes[i].values()).count(times) == 1}
    same = [all(i == o for _, i, o in own) for own in pairs]
    agreed = [all(new.get(i) == o for _, i, o in own) for own in pairs]
    kept = [w for w, unchanged, fits in zip(matched, same, agreed) if unchanged or fits]
    literals = {w["at"] + j for w in kept for j in range(w["width"]) if w["mask"] >> j & 1}
    if len(literals) < least:
        return [w["at"] for w, unchanged in zip(matched, same) if unchanged], False
    return [w["at"] for w in kept], any(fits and not u for u, fits in zip(same, agreed))


def judge(aligned: DataFrame) -> DataFrame:
    """Replace the windows of every alignment by the places that count, and ``changed``."""
    kept = [c for c in aligned.columns if c not in ("least", "matched")]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [judged(matched, least) for matched, least in
                       zip(batch.column("matched").to_pylist(), batch.column("least").to_pylist())]
            arrays = [batch.column(c) for c in kept]
            arrays.append(pa.array([sorted(set(places)) for places, _ in results], pa.list_(pa.int32())))
            arrays.append(pa.array([changed for _, changed in results], pa.bool_()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "places", "changed"])

    schema = T.StructType(
        [aligned.schema[c] for c in kept]
        + [T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("changed", T.BooleanType())]
    )
    return aligned.mapInArrow(compute, schema)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per contaminated document and item, with ``text_key`` (hash of the document's text),
    windows matched and asked for, and ``kind``: ``exact`` or ``reparameterised``."""
    items = written(
        windows(
            benchmark.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")),
            ["item"], "text", [], None, own_width=True,
        ).withColumn("width", F.size(F.split("shape", " "))),
        "benchmark-windows",
    )
    hashes = items.select("h", "width").distinct()
    widths = sorted(r["width"] for r in hashes.select("width").distinct().collect())
    small = hashes.limit(CARRIED_HASHES + 1).count() <= CARRIED_HASHES
    wanted = (
        np.unique(hashes.select("h").toArrow()["h"].to_numpy().view(np.uint64)) if small else None
    )
    keyed = docs.select(
        F.col(id_column).alias("id"),
        F.xxhash64(whole_text(text_column)).alias("text_key"),
        F.col(text_column).alias("text"),
    )
    found = windows(keyed, ["id", "text_key"], "text", widths, wanted, own_width=False)
    d, b = found.alias("d"), items.alias("b")
    # The shape is compared too: a hash alone could collide.
    pairs = d.join(b, (F.col("d.h") == F.col("b.h")) & (F.col("d.shape") == F.col("b.shape"))).select(
        "d.id", "d.text_key", "b.item", "b.width", "b.n_windows", "b.n_template", "b.least",
        (F.col("d.at") - F.col("b.at")).alias("shift"),
        F.struct(
            "b.at", "b.width", "b.mask",
            F.arrays_zip(F.col("b.slots").alias("i"), F.col("d.slots").alias("o")).alias("slots"),
        ).alias("window"),
    )
    # An alignment has at most the item's windows, each position once by template and once verbatim.
    aligned = pairs.groupBy("id", "text_key", "item", "shift").agg(
        F.max("n_windows").alias("n_windows"),
        F.max("n_template").alias("n_template"),
        F.max("width").alias("width"),
        F.max("least").alias("least"),
        F.collect_set("window").alias("matched"),
    )
    merged = (
        judge(aligned)
        .where(F.size("places") > 0)
        .groupBy("id", "text_key", "item")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("windows"),
            F.max("n_windows").alias("n_all"),
            F.max("n_template").alias("n_template"),
            F.max("width").alias("width"),
            F.max("changed").alias("changed"),
        )
        # Every window can be found verbatim, but with other values only those with literals.
        .withColumn("n_windows", F.when(F.col("changed"), F.col("n_template")).otherwise(F.col("n_all")))
    )
    enough = (F.col("windows") >= COVERED_SHARE * F.col("n_windows")) | (
        F.col("windows") + F.col("width") - 1 >= COVERED_TOKENS
    )
    return merged.where(enough).select(
        F.col("id").alias(id_column),
        F.col("item").alias(item_column),
        "text_key",
        F.col("windows").cast("bigint").alias("windows"),
        F.col("n_windows").cast("bigint").alias("item_windows"),
        F.when(F.col("changed"), "reparameterised").otherwise("exact").alias("kind"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          **names) -> DataFrame:
    """The documents that no item contaminates, with their columns."""
    bad = contaminated(docs, benchmark, id_column, text_column, **names)
    bad = bad.select(F.col(id_column).alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    same = docs[id_column].eqNullSafe(bad["bad_id"]) & (
        F.xxhash64(F.coalesce(docs[text_column], F.lit(""))) == bad["bad_key"]
    )
    return docs.join(bad, same, "left_anti")
