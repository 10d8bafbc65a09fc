"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

A text is a row of words; a chain is a sentence, cut every ``CHAIN_WORDS`` words.  Each word has one
of two tags, clean or toxic.  The score of a tag sequence adds the weights of the words tagged toxic
(hashed features: the word, its prefixes and suffixes, its length) and of the steps between tags.
Forward and backward passes give the probability that a word is toxic in its sentence.

Labels mark documents, so words are labelled first: a word of a toxic document is toxic if one of its
features is surely more frequent in toxic than in other documents (lower bound of the log odds ratio),
all other words are clean.  The field is fitted to these labels by L-BFGS; the marginals of rows kept
from that fit give the document score, a logistic function of their expected number and greatest value.

Learning takes at most ``TRAINING_TEXTS`` labelled rows of each label in hash order, and of those
whole texts up to ``TRAINING_BYTES``; prediction reads every whole text.  Nulls: a null text is
empty and scores as such; null ids and null labels teach nothing; of several labels of an id
the greatest holds.  Without both labels every score is the share of label 1 (0 without labels).
Repeated rows give repeated results; an empty table gives an empty result.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.llm.common import bounded_batches, slices, whole_text, worker_memory, written

TRAINING_TEXTS = 2_000
TRAINING_BYTES = 16 << 20
SPARE = 4
# Every n-th training row is kept from the field and used to fit the document score.
CALIBRATION_PART = 4
CHAIN_WORDS = 64
FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6)
SUFFIXES = (3, 4)
N_FEATURES = 2 + len(PREFIXES) + len(SUFFIXES)
# A word of a toxic document is toxic if a feature's log odds ratio is at least this, less two errors.
LEAST_ODDS = 1.0
LEAST_SEEN = 3
PENALTY = 0.3
STEPS = 50
# A word above this probability belongs to a span.
SPAN_PROBABILITY = 0.5
REMEMBERED_WORDS = 1_000_000
TOKENS = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = ".!?\n"


def mixed(numbers: np.ndarray, salt: int) -> np.ndarray:
    """Places in the weight table, from 1."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    found = (numbers.astype(np.uint64) + np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))) * odd
    found = (found ^ (found >> np.uint64(29))) * odd
    return 1 + ((found >> np.uint64(24)) % np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)


def ends_hashed(parts: list[str], lengths: Sequence[int], salt: int) -> list[np.ndarray]:
    """Hashes of the first characters of each part, as many as each length; 0 where none follow."""
    width = max(lengths) + 1
    letters = np.array(parts, f"U{width}").view(np.uint32).reshape(-1, width).astype(np.uint64)
    found, so_far = [], np.zeros(len(parts), np.uint64)
    for k in range(max(lengths)):
        so_far = (so_far + letters[:, k]) * np.uint64(0x100000001B3)
        if k + 1 in lengths:
            found.append(np.where(letters[:, k + 1] > 0, mixed(so_far, salt + k), 0))
    return found


def word_features(words: Sequence[str]) -> np.ndarray:
    """Places of each word's features in the weight table; place 0 stands for none."""
    lower = [word.lower() for word in words]
    if not lower:
        return np.zeros((0, N_FEATURES), np.int64)
    whole = np.fromiter((zlib.crc32(word.encode()) for word in lower), np.uint64, len(lower))
    length = np.fromiter(map(len, lower), np.uint64, len(lower))
    longest = max(SUFFIXES) + 1
    columns = [mixed(whole, 1), mixed(np.minimum(length, 12), 2), *ends_hashed(lower, PREFIXES, 100)]
    columns += ends_hashed([word[: -longest - 1 : -1] for word in lower], SUFFIXES, 200)
    return np.stack(columns, axis=1)


def by_word(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Emission of each word: the bias (place 0) and the weights of its features."""
    return weights[0] + np.where(features > 0, weights[features], 0).sum(axis=1)


@dataclass
class Field:
    """Weights of the features (place 0 is the bias) and of the steps, and of the document score."""

    weights: np.ndarray
    steps: np.ndarray  # to toxic, to clean, staying toxic, beginning toxic; staying clean is 0
    document: np.ndarray  # of 1, log of the expected number, log odds of the greatest
    share: float


class Chains:
    """Sentences of many texts, laid out step by step: all first words, all second words and so on.

    Chains stand in order of falling length, so the k-th words of all chains that have one are a
    slice and both passes run over slices.
    """

    def __init__(self, is_end: np.ndarray, text_of: np.ndarray):
        words = np.flatnonzero(~is_end)
        text = text_of[words]
        new = np.ones(len(words), bool)
        new[1:] = (np.diff(words) > 1) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
        place %= CHAIN_WORDS
        starts = np.flatnonzero(place == 0)
        lengths = np.diff(np.append(starts, len(words)))
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max()) if len(lengths) else 0
        # How many chains have a k-th word, and where those of step k begin.
        self.active = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")
        self.offsets = np.append(0, np.cumsum(self.active))
        self.words, self.text, self.first = words, text, place == 0
        self.layout = self.offsets[place] + np.repeat(rank, lengths)

    def marginals(self, emissions: np.ndarray, steps: np.ndarray, gradient: bool = False):
        """Probability of toxic for each word; with the log of the norm and step counts if asked.

        Both passes carry the ratio of toxic to clean.
        """
        to, back, stay, begin = np.exp(np.clip(steps, -30, 30))
        factor = np.empty(len(emissions))
        factor[self.layout] = np.exp(np.clip(emissions, -30, 30))
        odds = np.empty(len(factor))
        norm, expected = 0.0, np.zeros(4)
        ratio = np.zeros(0)
        for k, n in enumerate(self.active):
            at = slice(self.offsets[k], self.offsets[k] + n)
            if k == 0:
                ratio = factor[at] * begin
            else:
                if gradient:
                    norm += np.log1p(ratio[n:]).sum()
                ratio = ratio[:n]
                clean = 1 + back * ratio
                if gradient:
                    norm += np.log(clean).sum()
                ratio = factor[at] * (to + stay * ratio) / clean
            odds[at] = ratio
        if gradient:
            norm += np.log1p(ratio).sum()
        after = np.zeros(0)
        for k in range(len(self.active) - 1, -1, -1):
            n, m = self.active[k], len(after)
            ahead = np.ones(n)
            if m:
                below = self.offsets[k + 1]
                inside = factor[below : below + m] * after
                ahead[:m] = (back + stay * inside) / (1 + to * inside)
                if gradient:
                    r = odds[self.offsets[k] : self.offsets[k] + m]
                    pairs = np.stack([to * inside, r * back, r * stay * inside])
                    expected[:3] += (pairs / (1 + pairs.sum(axis=0))).sum(axis=1)
            odds[self.offsets[k] : self.offsets[k] + n] *= ahead
            after = ahead
        toxic = (odds / (1 + odds))[self.layout]
        if gradient:
            expected[3] = toxic[self.first].sum()
            return toxic, norm, expected
        return toxic


def tokens_of(texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """All tokens of the texts, words and sentence ends, and the text of each."""
    found = [TOKENS.findall(text) for text in texts]
    flat = [token for tokens in found for token in tokens]
    return flat, np.repeat(np.arange(len(texts)), [len(tokens) for tokens in found])


def document_features(toxic: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    clipped = np.clip(toxic, 1e-9, 1 - 1e-9)
    expected = np.bincount(text, clipped, n_texts)
    greatest = np.full(n_texts, 1e-9)
    np.maximum.at(greatest, text, clipped)
    return np.stack([np.ones(n_texts), np.log(expected + 1e-3), np.log(greatest / (1 - greatest)) / 4], axis=1)


def lbfgs(value_and_gradient, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimum of a smooth convex function by limited-memory BFGS with halved steps."""
    x, (value, gradient) = start, value_and_gradient(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, past = -gradient, []
        for s, y in reversed(pairs):
            a = s @ direction / (s @ y)
            direction = direction - a * y
            past.append(a)
        if pairs:
            s, y = pairs[-1]
            direction = direction * (s @ y) / (y @ y)
        else:
            direction = direction / max(1.0, float(np.abs(gradient).max()))
        for (s, y), a in zip(pairs, reversed(past)):
            direction = direction + (a - y @ direction / (s @ y)) * s
        slope, length = float(direction @ gradient), 1.0
        while length > 1e-8:
            moved = x + length * direction
            new_value, new_gradient = value_and_gradient(moved)
            if new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = moved - x, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, gradient = moved, new_value, new_gradient
        if done:
            break
    return x


def labelled_types(features: np.ndarray, kinds: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Whether each distinct word is toxic where a toxic document has it."""
    seen = np.zeros((2, 1 << FEATURE_BITS))
    for kind, label in zip(kinds, labels):
        present = np.unique(features[np.unique(kind)]) if len(kind) else np.zeros(0, int)
        seen[int(label), present] += 1
    total = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    has, lacks = seen + 0.5, total - seen + 0.5
    odds = np.log(has[1] / lacks[1]) - np.log(has[0] / lacks[0])
    error = np.sqrt((1 / has + 1 / lacks).sum(axis=0))
    evident = (odds - 2 * error >= LEAST_ODDS) & (seen[1] >= LEAST_SEEN)
    evident[0] = False
    return evident[features].any(axis=1)


def train(texts: Sequence[str], labels: Sequence[int]) -> Field:
    """The field learnt from texts and their labels (1: toxic)."""
    marks = np.array(labels, int)
    share = float(marks.mean()) if len(marks) else 0.0
    nothing = Field(np.zeros(1 << FEATURE_BITS), np.zeros(4), np.zeros(3), share)
    if len(set(labels)) < 2:
        return nothing
    # Both labels are dealt out in turn, so each part has its share of either.
    turn = np.empty(len(marks), int)
    for label in (0, 1):
        turn[marks == label] = np.arange((marks == label).sum())
    held = turn % CALIBRATION_PART == CALIBRATION_PART - 1
    if len(set(marks[held])) < 2:
        held[:] = False
    fitted = np.flatnonzero(~held)
    # Tokens become numbers text by text; sentence ends come first.
    codes = {end: k for k, end in enumerate(ENDS)}
    found = [
        np.fromiter((codes.setdefault(t, len(codes)) for t in TOKENS.findall(texts[k])), np.int32) for k in fitted
    ]
    kind = np.concatenate(found)
    chains = Chains(kind < len(ENDS), np.repeat(np.arange(len(fitted)), [len(part) for part in found]))
    kind = kind[chains.words]
    features = word_features(list(codes))
    bounds = np.searchsorted(chains.text, np.arange(len(fitted) + 1))
    kinds = [kind[a:b] for a, b in zip(bounds, bounds[1:])]
    toxic_type = labelled_types(features, kinds, marks[fitted])
    tags = toxic_type[kind] & (marks[fitted][chains.text] == 1) if len(kind) else np.zeros(0, bool)
    # Steps that the labels take.
    first = chains.first
    before, now = tags[:-1][~first[1:]], tags[1:][~first[1:]]
    taken = np.array([(~before & now).sum(), (before & ~now).sum(), (before & now).sum(), tags[first].sum()], float)
    of_type = np.bincount(kind, tags, len(codes))
    size = 1 << FEATURE_BITS

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, steps = x[:size], x[size:]
        by_type = by_word(weights, features)
        found, norm, expected = chains.marginals(by_type[kind], steps, gradient=True)
        value = norm - by_type @ of_type - steps @ taken + PENALTY / 2 * float(x[1:] @ x[1:])
        excess = np.bincount(kind, found, len(codes)) - of_type
        slope = PENALTY * x
        slope[:size] += np.bincount(features.ravel(), np.repeat(excess, N_FEATURES), size)
        # Place 0 marks absent features, so the bias has its own sum.
        slope[0] = excess.sum()
        slope[size:] += expected - taken
        return float(value), slope

    start = np.zeros(size + 4)
    start[0] = -4.0
    x = lbfgs(objective, start, STEPS)
    field = Field(x[:size], x[size:], np.zeros(3), share)
    used = np.flatnonzero(held) if held.any() else fitted
    rows = Tagger(field).features([texts[k] for k in used])
    y = marks[used]

    def document(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows @ w
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = np.logaddexp(0, z).sum() - z @ y + 0.05 * float(w[1:] @ w[1:])
        return float(value), rows.T @ (p - y) + 0.1 * np.append(0, w[1:])

    field.document = lbfgs(document, np.zeros(3), 200)
    return field


class Tagger:
    """Marginals, document scores and spans of texts, with the emissions a worker has met."""

    def __init__(self, field: Field):
        self.field = field
        self.emissions: dict[str, float] = {}

    def marginals(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of every word its probability and its text."""
        flat, text_of = tokens_of(texts)
        known = self.emissions
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        if not known:
            known.update(dict.fromkeys(ENDS, float("nan")))
        new = list(set(flat).difference(known))
        known.update(zip(new, by_word(self.field.weights, word_features(new)).tolist()))
        emissions = np.fromiter(map(known.__getitem__, flat), float, len(flat))
        chains = Chains(np.isnan(emissions), text_of)
        return chains.marginals(emissions[chains.words], self.field.steps), chains.text

    def features(self, texts: Sequence[str]) -> np.ndarray:
        return document_features(*self.marginals(texts), len(texts))

    def scores(self, texts: Sequence[str], spans: bool = True) -> tuple[list[float], list[list[dict]]]:
        """Score of each text, and its toxic spans as code points with the mean probability."""
        toxic, text = self.marginals(texts)
        rows = document_features(toxic, text, len(texts))
        if self.field.document.any():
            found = 1 / (1 + np.exp(-np.clip(rows @ self.field.document, -500, 500)))
        else:
            found = np.full(len(texts), self.field.share)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        listed: list[list[dict]] = [[] for _ in texts]
        for k in np.unique(text[toxic >= SPAN_PROBABILITY]) if spans else ():
            listed[k] = spans_of(texts[k], toxic[bounds[k] : bounds[k + 1]])
        return found.tolist(), listed


def spans_of(text: str, toxic: np.ndarray) -> list[dict]:
    """Runs of toxic words within a sentence: start, end (exclusive) and mean probability."""
    spans: list[list] = []
    at, joined = 0, False
    for match in TOKENS.finditer(text):
        if match[0] in ENDS:
            joined = False
            continue
        p = float(toxic[at])
        at += 1
        if p < SPAN_PROBABILITY:
            joined = False
            continue
        if joined:
            spans[-1][1] = match.end()
            spans[-1][2].append(p)
        else:
            spans.append([match.start(), match.end(), [p]])
        joined = True
    return [{"start": a, "end": b, "probability": sum(p) / len(p)} for a, b, p in spans]


def training_sample(
    docs: DataFrame, labels: DataFrame, eligible: Column, id_column: str, text_column: str, label_column: str
) -> tuple[list[str], list[int]]:
    """Texts and labels in hash order, within the stated bounds.

    A threshold on the hash, from the count of each label, leaves about ``SPARE`` times the bound
    of labels whatever the table's size; those few and then the chosen ids are sent to the scan
    of the documents, so no text is shuffled but the chosen ones.  Of an id with several texts the
    one of the least hash is taken.
    """
    marks = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(
        F.col(id_column).alias("key")
    ).agg(F.max(F.when(F.col(label_column) == 1, 1).otherwise(0)).alias("label"))
    order = F.xxhash64("key", "label")
    marks = marks.withColumns({"order": order, "unit": F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))})
    counts = {r["label"]: r["rows"] for r in marks.groupBy("label").agg(F.count("*").alias("rows")).collect()}
    shares = [SPARE * TRAINING_TEXTS / max(1, counts.get(label, 0)) for label in (0, 1)]
    share = F.when(F.col("label") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    near = few(marks.where(F.col("unit") < share).select("key", "label", "order"))
    texts = docs.where(eligible & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("key"), whole_text(text_column).alias("text")
    )
    hashed = F.xxhash64("text")
    sizes = texts.withColumn("size", F.octet_length("text")).join(near, "key").groupBy("key", "label", "order").agg(
        F.min_by("size", hashed).alias("size")
    )
    by_label = Window.partitionBy("label").orderBy("order", "key")
    so_far = F.sum("size").over(by_label.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sizes.withColumns({"place": F.row_number().over(by_label), "so_far": so_far})
    chosen = ranked.where((F.col("place") <= TRAINING_TEXTS) & (F.col("so_far") <= TRAINING_BYTES))
    found = texts.join(few(chosen.select("key", "label", "place")), "key").groupBy("label", "place").agg(
        F.min_by("text", hashed).alias("text")
    ).orderBy("label", "place").select("text", "label").toArrow()
    return found["text"].to_pylist(), found["label"].to_pylist()


def few(keys: DataFrame) -> DataFrame:
    """Keys of bounded number, written down and checked before they are sent to every task."""
    kept = written(keys, "toxic-keys")
    return F.broadcast(kept) if kept.count() <= 4 * SPARE * TRAINING_TEXTS else kept


def fit(
    docs: DataFrame, labels: DataFrame, eligible: Column, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic",
) -> Field:
    return train(*training_sample(docs, labels, eligible, id_column, text_column, label_column))


def tag(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``score`` and ``spans`` (start, end, probability; code points) of every whole text."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_column), whole_text(text_column).alias(text_column))
    kind = source.schema[0].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    kept = f"toxic_spans:{uuid.uuid4().hex}"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = worker_memory(kept, lambda: Tagger(field))
        for whole in batches:
            for batch in slices(whole):
                scores, listed = tagger.scores(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64()), pa.array(listed, spans)],
                    names=[id_column, "score", "spans"],
                )

    return source.mapInArrow(
        compute,
        f"`{id_column}` {kind}, score double, spans array<struct<start: bigint, end: bigint, probability: double>>",
    )
