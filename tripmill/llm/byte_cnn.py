"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of one length.  In a window, filters of several widths
run over byte embeddings, each filter keeps its largest answer, and a softmax over the
languages follows.  A text's scores are the mean of its windows' log probabilities.

The convolution of a width is a sum of table look-ups: embedding and filter are multiplied
once into a table per byte position, and neighbouring positions are merged into a table of
byte pairs, so a window costs no multiplications.

Training takes a bounded sample of labelled texts (``TRAINING_TEXTS`` of each language, the first
in the order of a hash) on the driver; every text of the table is then predicted in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.llm.common import bounded_batches, slices, spare_name, whole_text

UNKNOWN = "und"
WINDOW_BYTES = 192
EMBEDDING = 12
WIDTHS = (2, 3, 4)
FILTERS = 12
# The bound of the training sample, which reaches the driver: texts of each language, and windows
# of each text, from places anywhere in it.  Prediction has no such bound.
TRAINING_TEXTS = 400
TRAINING_WINDOWS = 3
EPOCHS = 12
RATE = 0.05
# Languages whose counts reach the driver; more are refused.
MOST_LANGUAGES = 10_000
SEED = 42
BATCH_WINDOWS = 4096
# One sampled text of so many is kept from training to set the energy limits.
LIMIT_SHARE = 5
# A text with a larger share of bytes that no training text has is in no learnt language.
MOST_UNSEEN = 0.1
PADDING = 256


@dataclass
class Network:
    """Weights; byte 256 pads the end of a text."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def text_windows(text: str, most: int | None = None) -> np.ndarray:
    """Windows of a whole text, the last one padded; ``most`` spread ones for training."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.int16)
    count = max(1, -(-len(raw) // WINDOW_BYTES))
    padded = np.full(count * WINDOW_BYTES, PADDING, np.int16)
    padded[: len(raw)] = raw
    found = padded.reshape(count, WINDOW_BYTES)
    if most is not None and count > most:
        found = found[np.linspace(0, count - 1, most).astype(int)]
    return found


def positions(width: int) -> int:
    return WINDOW_BYTES - width + 1


def train(texts: list[str], labels: list[str], seed: int = SEED) -> Network:
    """Adam on the cross entropy of single windows."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    cut = [text_windows(t, TRAINING_WINDOWS) for t in texts]
    x = np.concatenate(cut).astype(np.int64)
    y = np.repeat([languages.index(label) for label in labels], [len(c) for c in cut])
    net = Network(
        languages,
        rng.normal(0, 0.3, (PADDING + 1, EMBEDDING)).astype(np.float32),
        [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.embed[PADDING] = 0
    weights = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            grads = gradients(net, x[some], y[some])
            step += 1
            rate = RATE * (0.2 + 0.8 * (1 - epoch / EPOCHS)) * 0.2
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    # Bytes that training never saw say nothing, instead of what their drawn start happens to say.
    net.embed[np.setdiff1d(np.arange(PADDING), x)] = 0
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy, for all weights in their order."""
    rows = np.arange(len(x))[:, None]
    lanes = np.arange(FILTERS)[None, :]
    embedded = net.embed[x]
    pooled, best = [], []
    for width, filters, bias in zip(WIDTHS, net.filters, net.bias):
        n = positions(width)
        answer = sum(embedded[:, j : j + n] @ filters[j] for j in range(width)) + bias
        best.append(answer.argmax(axis=1))
        pooled.append(np.maximum(answer[rows, best[-1], lanes], 0))
    hidden = np.concatenate(pooled, axis=1)
    logits = hidden @ net.out + net.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    share = np.exp(logits)
    share /= share.sum(axis=1, keepdims=True)
    share[np.arange(len(x)), y] -= 1
    share /= len(x)
    d_hidden = (share @ net.out.T) * (hidden > 0)
    d_embed = np.zeros_like(net.embed)
    d_filters, d_bias = [], []
    for k, (width, filters) in enumerate(zip(WIDTHS, net.filters)):
        d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
        own = np.zeros_like(filters)
        for j in range(width):
            # The byte under position j of each filter's best place.
            seen = x[rows, best[k] + j]
            own[j] = np.einsum("nfe,nf->ef", net.embed[seen], d)
            np.add.at(d_embed, seen.ravel(), (d[:, :, None] * filters[j].T[None]).reshape(-1, EMBEDDING))
        d_filters.append(own)
        d_bias.append(d.sum(axis=0))
    d_embed[PADDING] = 0
    return [d_embed, *d_filters, *d_bias, hidden.T @ share, share.sum(axis=0)]


class Predictor:
    """The network with its convolutions as look-up tables."""

    def __init__(self, net: Network):
        self.net = net
        self.unseen = ~net.embed.any(axis=1) if net.languages else np.zeros(PADDING + 1, bool)
        self.unseen[PADDING] = False
        # tables[k] = list of (first byte's offset, table, is a pair)
        self.tables = []
        for filters in net.filters:
            own = [net.embed @ f for f in filters]
            merged = []
            for j in range(0, len(own) - 1, 2):
                pair = own[j][:, None, :] + own[j + 1][None, :, :]
                merged.append((j, pair.reshape(-1, FILTERS), True))
            if len(own) % 2:
                merged.append((len(own) - 1, own[-1], False))
            self.tables.append(merged)

    def log_shares(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages for every window."""
        return self.shares_and_energy(windows)[0]

    def shares_and_energy(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the languages, and the energy (log of the summed exponentials).

        Filters that were trained on some languages answer weakly to others, so a window of a
        language nobody taught has low energy, even where its best share is high.
        """
        bytes_ = windows.astype(np.int32)
        pairs = bytes_[:, :-1] * (PADDING + 1) + bytes_[:, 1:]
        pooled = []
        for width, merged, bias in zip(WIDTHS, self.tables, self.net.bias):
            n = positions(width)
            answer = None
            for j, rows, is_pair in merged:
                found = rows[(pairs if is_pair else bytes_)[:, j : j + n]]
                answer = found if answer is None else np.add(answer, found, out=answer)
            pooled.append(np.maximum(answer.max(axis=1) + bias, 0))
        logits = np.concatenate(pooled, axis=1) @ self.net.out + self.net.out_bias
        logits = logits.astype(np.float64)
        most = logits.max(axis=1, keepdims=True)
        energy = most + np.log(np.exp(logits - most).sum(axis=1, keepdims=True))
        return logits - energy, energy[:, 0]

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of every text; without a letter, ``und`` and 0."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and mean energy of the full windows (none: infinite) of every text.

        The energy is minus infinity where over ``MOST_UNSEEN`` of the bytes never came up in training.
        """
        lettered = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        energies = [math.inf] * len(texts)
        if not lettered or not self.net.languages:
            return names, scores, energies
        summed = np.zeros((len(texts), len(self.net.languages)))
        counts = np.zeros(len(texts))
        heated, full, odd = (np.zeros(len(texts)) for _ in range(3))
        held, owners, size = [], [], 0

        def flush() -> None:
            windows, owner = np.concatenate(held), np.concatenate(owners)
            for at in range(0, len(windows), BATCH_WINDOWS // 8):
                part = slice(at, at + BATCH_WINDOWS // 8)
                shares, energy = self.shares_and_energy(windows[part])
                np.add.at(summed, owner[part], shares)
                whole = windows[part][:, -1] != PADDING
                np.add.at(heated, owner[part][whole], energy[whole])
                np.add.at(full, owner[part][whole], 1)
                np.add.at(odd, owner[part], self.unseen[windows[part]].sum(axis=1))
            np.add.at(counts, owner, 1)
            held.clear()
            owners.clear()

        for k in lettered:
            own = text_windows(texts[k])
            held.append(own)
            owners.append(np.full(len(own), k))
            size += len(own)
            if size >= BATCH_WINDOWS:
                flush()
                size = 0
        if held:
            flush()
        for k in lettered:
            mean = summed[k] / counts[k]
            share = np.exp(mean - mean.max())
            share /= share.sum()
            best = int(share.argmax())
            names[k], scores[k] = self.net.languages[best], float(share[best])
            if full[k]:
                energies[k] = float(heated[k] / full[k])
            if odd[k] > MOST_UNSEEN * len(texts[k].encode()):
                energies[k] = -math.inf
        return names, scores, energies


def training_sample(
    docs: DataFrame, eligible: Column, id_column: str, text_column: str, language_column: str
) -> tuple[list[list[str]], list[str]]:
    """Pieces of the first texts of each language in hash order, from all eligible labelled rows.

    A text of more than a few windows gives pieces of a window's length from places that hashes
    choose anywhere in it; a shorter one is a piece itself.  A threshold on the hash, from the count of each language, comes before the ranking, so the
    ranking sees about twice the bound of each language whatever the table's size.
    """
    labelled = docs.where(eligible & F.col(language_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    rank = F.xxhash64(F.col(id_column), F.xxhash64(text_column))
    unit = F.shiftrightunsigned(rank, 11) / F.lit(float(1 << 53))
    text, length = F.col(text_column), F.char_length(text_column)
    whole = length <= TRAINING_WINDOWS * WINDOW_BYTES
    room = F.greatest(length - WINDOW_BYTES, F.lit(1))
    places = [F.pmod(F.xxhash64(rank, F.lit(k)), room) + 1 for k in range(TRAINING_WINDOWS)]
    spread = F.array(*[F.substring(text, place.cast("int"), F.lit(WINDOW_BYTES)) for place in places])
    pieces = F.when(whole, F.array(text)).otherwise(spread)
    rows = labelled.select(F.col(language_column).alias("language"), pieces.alias("pieces"),
                           rank.alias("rank"), unit.alias("unit"))
    counts = rows.groupBy("language").agg(F.count("*").alias("rows"))
    known = counts.limit(MOST_LANGUAGES + 1).toArrow()
    if known.num_rows > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # The shares are a checked, small table, so the filter runs in the scan and few rows are shuffled.
    shares = F.broadcast(docs.sparkSession.createDataFrame(known))
    near = rows.join(shares, "language").where(
        F.col("unit") * F.col("rows") < 2.0 * TRAINING_TEXTS + 100
    )
    place = F.row_number().over(Window.partitionBy("language").orderBy("rank", "pieces"))
    chosen = near.withColumn("place", place).where(F.col("place") <= TRAINING_TEXTS)
    found = chosen.orderBy("language", "place").select("language", "pieces").toArrow()
    return found["pieces"].to_pylist(), found["language"].to_pylist()


def fit(docs: DataFrame, eligible: Column, id_column: str = "doc_id", text_column: str = "text",
        language_column: str = "lang") -> Network:
    """The network learnt from the eligible labelled rows; without any, it knows no language."""
    return learnt(*training_sample(docs, eligible, id_column, text_column, language_column))


def learnt(sample: list[list[str]], labels: list[str]) -> Network:
    """The network of sampled pieces."""
    if not sample:
        return Network([], np.zeros(0), [], [], np.zeros(0), np.zeros(0))
    flat = [(piece, label) for pieces, label in zip(sample, labels) for piece in pieces]
    return train([piece for piece, _ in flat], [label for _, label in flat])


def fit_known(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang"
) -> tuple[Network, dict[str, float]]:
    """A network, and for each of its languages the least energy of a text in that language.

    Every fifth sampled text is kept from training.  The least energy is half of what all but a
    hundredth of a language's kept texts reach, so that odd texts of the language stay.  A
    language without a kept text of a full window has no limit.
    """
    sample, labels = training_sample(docs, F.lit(True), id_column, text_column, language_column)
    learn = [k for k in range(len(sample)) if k % LIMIT_SHARE]
    if set(labels) != {labels[k] for k in learn}:
        learn = list(range(len(sample)))
    net = learnt([sample[k] for k in learn], [labels[k] for k in learn])
    predictor = Predictor(net)
    reached: dict[str, list[float]] = {}
    for k in range(0, len(sample), LIMIT_SHARE):
        found = [e for e in predictor.judged(sample[k])[2] if math.isfinite(e)]
        if found:
            reached.setdefault(labels[k], []).append(float(np.mean(found)))
    return net, {name: float(np.quantile(found, 0.01)) / 2 for name, found in reached.items()}


def predict(
    docs: DataFrame, net: Network, text_column: str = "text", limits: dict[str, float] | None = None
) -> DataFrame:
    """The table with two more columns, ``lang_pred`` and ``score``.

    With ``limits``, a text whose energy is below the limit of its best language is in no language
    that was learnt: it is ``und`` too, and keeps its score.  Less than a full window has no energy,
    so there only bytes that training never saw tell.

    Where the table has such a column already, the new one gets underscores in front.  Nulls: a
    null text is ``und``; other columns pass as they are.  Repeated rows give repeated results,
    an empty table an empty one.  Texts of any length are read whole, window by window.
    """
    bounded_batches(docs.sparkSession)
    name, score, own = (spare_name(docs, n) for n in ("lang_pred", "score", "text_read"))
    source = docs.withColumn(own, whole_text(text_column))
    names_out = [*docs.columns, name, score]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net)
        for whole in batches:
            for batch in slices(whole):
                kept = batch.num_columns - 1
                names, scores, energies = predictor.judged(batch.column(kept).to_pylist())
                least = limits or {}
                names = [
                    UNKNOWN if energy < least.get(name, -math.inf) else name
                    for name, energy in zip(names, energies)
                ]
                columns = [batch.column(k) for k in range(kept)]
                columns += [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    schema = T.StructType(
        [*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]
    )
    return source.mapInArrow(compute, schema)


def identified(
    docs: DataFrame, net: Network, limits: dict[str, float], text_column: str = "text"
) -> DataFrame:
    """The rows whose language is one of the learnt, with their own columns."""
    found = predict(docs, net, text_column, limits)
    return found.where(F.col(found.columns[-2]) != UNKNOWN).select(*docs.columns)
