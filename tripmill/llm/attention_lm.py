"""Language-model scoring: a causal self-attention model over subword ids, in numpy.

Words (ASCII lower-cased) are encoded with a public subword vocabulary, and one end id closes a
text.  The model reads windows of ``CONTEXT`` ids that overlap; a window scores its last ``STRIDE``
ids, so every id is scored once, with at least ``CONTEXT - STRIDE`` ids before it in sight.

Ids are ranked by their counts over all training text, and a rank is predicted digit by digit
(three digits of 32).  Each digit is a softmax with weights of its own for the digits before
it, so the probabilities of all ids sum to one at the cost of 96 exponentials.  The digits' biases
are the logarithms of the same corpus-wide counts.

The weights are fitted to every window of every training text, whole, in rounds.  A text belongs to
one round, by its hash; each round has ``GROWTH`` times the text of the rounds before it.  The first
is small enough for one task and is read until ``TRAINING_STEPS`` steps are done (a corpus that small
has this round only).  In the others each task moves its own copy of the weights over its texts, and the
moves are averaged row by row, weighted by the steps that used the row.

The base score is an add-one unigram over words.  Words too frequent for a join (at most
``2 ** FREQUENT_BITS`` by construction, since each has that share of all tokens) travel with the
scoring tasks; the others are joined with the corpus counts by a shuffle.

Nulls: a null text is empty and consists of the end; a null id is an id like any other.  Repeated
rows give repeated results and count as often in training.  Without training rows N and V are
0, the base is uniform and so is the model.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.llm.common import bounded_batches, forget, slices, whole_text, worker_memory, written
from tripmill.llm.fertility import WordIds
from tripmill.llm.pieces import calls

CONTEXT = 24
STRIDE = 16
WIDTH = 24
DIGIT = 32
LEVELS = 3
IDS = DIGIT**LEVELS
END_ID = 2
START_ID = IDS - 1
PAD_ID = -1
# The least steps of the first round, and windows in a step of the first and of the other rounds.
TRAINING_STEPS = 1500
BATCH = 128
LATER_BATCH = 512
GROWTH = 8
# Windows that a task mixes before it learns them.
MIXED_WINDOWS = 16_384
SUM_TASKS = 16
SCORED_WINDOWS = 512
RATE = 0.01
LATER_RATE = 0.005
SEED = 42
SMOOTHING = 0.05
FREQUENT_BITS = 20
END_WORD = b""
# Distinct words that one task counts before it hands them on.
COUNTED_WORDS = 300_000
# Distinct words that a worker remembers, beside those of one batch.
MET_WORDS = 300_000


# ---- the model -------------------------------------------------------------------------------


def digit_biases(counts: np.ndarray) -> list[np.ndarray]:
    """Log shares of each digit given the digits before it, from counts of all ids."""
    leaves = counts.reshape(DIGIT, DIGIT, DIGIT) + SMOOTHING
    tables = [leaves.sum(axis=(1, 2))[None, :], leaves.sum(axis=2), leaves.reshape(-1, DIGIT)]
    return [np.log(t / t.sum(axis=1, keepdims=True)).astype(np.float32) for t in tables]


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    square = {k: normal(WIDTH, WIDTH, scale=WIDTH**-0.5) for k in ("query", "key", "value", "join")}
    return {
        # The last row stands for padding.
        "embed": np.concatenate([normal(IDS, WIDTH, scale=0.3), np.zeros((1, WIDTH), np.float32)]),
        "place": normal(CONTEXT, WIDTH, scale=0.1),
        **square,
        # For each level, the weights of every digit behind each prefix.
        **{f"out{k}": np.zeros((DIGIT**k, WIDTH, DIGIT), np.float32) for k in range(LEVELS)},
    }


def causal_mask() -> np.ndarray:
    """A scored position sees all positions up to its own."""
    query = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None]
    return (np.arange(CONTEXT)[None, :] <= query).astype(np.float32)


MASK = causal_mask()
# Bounds of attention scores and of logits; exponentials then need no shift.
REACH = 30.0
BOUND = 80.0
ROOT = np.float32(WIDTH**-0.5)
# Windows whose attention, and targets whose logits, stay in a core's cache.
CHUNK = 128
BLOCK = 1024


def projections(w: dict[str, np.ndarray]) -> np.ndarray:
    """What an input shows to the positions behind it: its key, turned so that queries are the inputs
    themselves, and its value, turned to what it adds to the hidden row."""
    return np.concatenate([w["key"] @ w["query"].T * ROOT, w["value"] @ w["join"]], axis=1)


def attend(seen: np.ndarray, asks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention of the scored positions and what it adds to their inputs."""
    attention = asks @ seen[..., :WIDTH].transpose(0, 2, 1)
    np.clip(attention, -REACH, REACH, out=attention)
    np.exp(attention, out=attention)
    attention *= MASK
    # Only a text's first window has padding that a real target could see.
    first = np.flatnonzero(ids[:, 0] == PAD_ID)
    if len(first):
        attention[first] *= (ids[first] != PAD_ID)[:, None, :]
    total = attention.reshape(-1, CONTEXT) @ np.ones(CONTEXT, np.float32) + np.float32(1e-30)
    attention /= total.reshape(-1, STRIDE, 1)
    return attention, attention @ seen[..., WIDTH:]


def digits_of(targets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, the digits before (as a number) and the digit."""
    bits = DIGIT.bit_length() - 1
    shifts = [bits * (LEVELS - 1 - level) for level in range(LEVELS)]
    return [(targets >> (s + bits), (targets >> s) & (DIGIT - 1)) for s in shifts]


def order_of(targets: np.ndarray) -> np.ndarray:
    """Stable order of ids, padding last; two bytes an id sort fastest."""
    return np.argsort(targets.astype(np.uint16), kind="stable")


def outputs(w: dict[str, np.ndarray], biases: list[np.ndarray]) -> list[np.ndarray]:
    """For each level and prefix, the weights of the digits with their biases as the last row."""
    return [np.concatenate([w[f"out{k}"], biases[k][:, None, :]], axis=1) for k in range(LEVELS)]


def runs_of(before: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Distinct prefixes of sorted targets, and their runs inside blocks: number, prefix, rows."""
    edges = np.flatnonzero(np.diff(before)) + 1
    nodes = before[np.concatenate([[0], edges])]
    starts = np.union1d(np.append(edges, 0), np.arange(0, len(before), BLOCK))
    which = np.searchsorted(edges, starts, side="right")
    ends = np.append(starts[1:], len(before))
    return nodes, list(zip(which.tolist(), nodes[which].tolist(), starts.tolist(), ends.tolist()))


Runs = list[list[tuple[int, int, int, int]]]


def logit_blocks(
    out: list[np.ndarray], flat: np.ndarray, hits: np.ndarray, runs: Runs
) -> Iterator[tuple[slice, np.ndarray, np.ndarray, Runs]]:
    """Blocks of rows with the logits of all digits by level, where the targets' digits are, and the runs inside."""
    room = np.empty(LEVELS * min(len(flat), BLOCK) * DIGIT, np.float32)
    rest = [iter(own) for own in runs]
    for lo in range(0, len(flat), BLOCK):
        hi = min(lo + BLOCK, len(flat))
        logits, inside = room[: LEVELS * (hi - lo) * DIGIT].reshape(LEVELS, hi - lo, DIGIT), []
        for level, own in enumerate(rest):
            mine = []
            for run in own:
                _, node, start, end = run
                np.matmul(flat[start:end], out[level][node], out=logits[level, start - lo : end - lo])
                mine.append(run)
                if end == hi:
                    break
            inside.append(mine)
        np.clip(logits, -BOUND, BOUND, out=logits)
        at = hits[:, lo:hi] + np.arange(LEVELS * (hi - lo)).reshape(LEVELS, -1) * DIGIT
        yield slice(lo, hi), logits, at, inside


def hits_of(levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.stack([digit for _, digit in levels])


def with_one(hidden: np.ndarray) -> np.ndarray:
    """Hidden rows with a 1 for the biases."""
    return np.concatenate([hidden, np.ones((len(hidden), 1), np.float32)], axis=1)


def target_logs(out: list[np.ndarray], flat: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of every target, 0 for padding; a row of flat ends with 1."""
    order = order_of(targets)[: np.count_nonzero(targets >= 0)]
    found = np.zeros(len(targets), np.float32)
    if len(order):
        levels = digits_of(targets[order])
        runs = [runs_of(before)[1] for before, _ in levels]
        for rows, logits, at, _ in logit_blocks(out, flat.take(order, axis=0), hits_of(levels), runs):
            total = logits.ravel()[at].sum(axis=0)
            sums = np.exp(logits, out=logits).reshape(-1, DIGIT) @ np.ones(DIGIT, np.float32)
            found[order[rows]] = total - np.log(sums).reshape(LEVELS, -1).sum(axis=0)
    return found


def log_shares(w, biases, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of every target; hidden is (targets, WIDTH)."""
    return target_logs(outputs(w, biases), with_one(hidden), targets)


def output_gradients(
    out: list[np.ndarray], flat: np.ndarray, targets: np.ndarray
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of the summed loss of sorted targets: gradients of the hidden rows, and of the weights of each prefix."""
    d_flat = np.empty((len(flat), WIDTH), np.float32)
    levels = digits_of(targets)
    nodes, runs = zip(*(runs_of(before) for before, _ in levels))
    own = [np.zeros((len(of_level), WIDTH + 1, DIGIT), np.float32) for of_level in nodes]
    for _, share, at, inside in logit_blocks(out, flat, hits_of(levels), runs):
        lo = inside[0][0][2]
        np.exp(share, out=share)
        sums = share.reshape(-1, DIGIT) @ np.ones(DIGIT, np.float32)
        share /= sums.reshape(LEVELS, -1, 1)
        share.reshape(-1)[at] -= 1
        for level, mine in enumerate(inside):
            for k, node, start, end in mine:
                part, behind = share[level, start - lo : end - lo], out[level][node, :WIDTH].T
                own[level][k] += flat[start:end].T @ part
                if level:
                    d_flat[start:end] += part @ behind
                else:
                    np.matmul(part, behind, out=d_flat[start:end])
    return d_flat, [(of_level, g[:, :WIDTH]) for of_level, g in zip(nodes, own)]


def gradients(w, out: list[np.ndarray], ids: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss of the real targets (padding is -1); out has the outputs of w.

    Inputs enter by rows of their ids, so projections and their gradients are taken once for an id.
    """
    lead = CONTEXT - STRIDE
    by_id = order_of(ids.ravel())
    used = ids.ravel()[by_id]
    first = np.flatnonzero(np.diff(used, prepend=-2))
    slots = np.empty(ids.shape, np.int64)
    slots.ravel()[by_id] = np.repeat(np.arange(len(first)), np.diff(first, append=len(used)))
    used = used[first]
    embed, project = w["embed"][used], projections(w)
    seen_rows, seen_place, asks_place = embed @ project, w["place"] @ project, w["place"][lead:]
    flat = np.ones((len(ids), STRIDE, WIDTH + 1), np.float32)
    parts = [slice(at, at + CHUNK) for at in range(0, len(ids), CHUNK)]
    kept = []
    for part in parts:
        seen = seen_rows.take(slots[part], axis=0)
        seen += seen_place
        asks = embed.take(slots[part, lead:], axis=0)
        asks += asks_place
        attention, mixed = attend(seen, asks, ids[part])
        np.add(asks, mixed, out=flat[part, :, :WIDTH])
        kept.append((seen, asks, attention, mixed))
    goal = targets.ravel()
    order = order_of(goal)[: np.count_nonzero(goal >= 0)]
    share = np.float32(1 / max(1, len(order)))
    d_hidden, g = np.zeros((len(goal), WIDTH), np.float32), {}
    if len(order):
        d_flat, own = output_gradients(out, flat.reshape(-1, WIDTH + 1).take(order, axis=0), goal[order])
        d_flat *= share
        d_hidden[order] = d_flat
        g = {f"out{level}": (nodes, of_level * share) for level, (nodes, of_level) in enumerate(own)}
    d_hidden = d_hidden.reshape(len(ids), STRIDE, WIDTH)
    # Of the keys, of the values and of the inputs themselves.
    d_seen = np.empty((len(ids), CONTEXT, 3 * WIDTH), np.float32)
    d_seen[:, :lead, 2 * WIDTH :] = 0
    for part, (seen, asks, attention, mixed) in zip(parts, kept):
        d_own, found = d_hidden[part], d_seen[part]
        np.matmul(attention.transpose(0, 2, 1), d_own, out=found[..., WIDTH : 2 * WIDTH])
        d_scores = d_own @ seen[..., WIDTH:].transpose(0, 2, 1)
        # The mean of these under the attention is the share of the mixed value.
        mixed *= d_own
        d_scores -= (mixed.reshape(-1, WIDTH) @ np.ones(WIDTH, np.float32)).reshape(-1, STRIDE, 1)
        d_scores *= attention
        np.matmul(d_scores.transpose(0, 2, 1), asks, out=found[..., :WIDTH])
        np.add(d_scores @ seen[..., :WIDTH], d_own, out=found[:, lead:, 2 * WIDTH :])
    d_place = d_seen.sum(axis=0)
    d_rows = np.add.reduceat(d_seen.reshape(-1, 3 * WIDTH).take(by_id, axis=0), first, axis=0)
    d_project = embed.T @ d_rows[:, : 2 * WIDTH] + w["place"].T @ d_place[:, : 2 * WIDTH]
    d_key, d_value = d_project[:, :WIDTH], d_project[:, WIDTH:]
    g["key"], g["query"] = d_key @ w["query"] * ROOT, d_key.T @ w["key"] * ROOT
    g["value"], g["join"] = d_value @ w["join"].T, w["value"].T @ d_value
    g["place"] = d_place[:, : 2 * WIDTH] @ project.T + d_place[:, 2 * WIDTH :]
    rows = d_rows[:, : 2 * WIDTH] @ project.T + d_rows[:, 2 * WIDTH :]
    # The row of the padding stays zero.
    rows[used == PAD_ID] = 0
    g["embed"] = (used, rows)
    return g


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input windows, targets of their last STRIDE ids (padding -1), and the text each belongs to."""
    inputs, targets, owner = [], [], []
    lead = CONTEXT - STRIDE
    for k, own in enumerate(ids):
        n = -(-len(own) // STRIDE)
        goal = np.full(n * STRIDE, PAD_ID, np.int32)
        goal[: len(own)] = own
        before = np.full(lead + n * STRIDE, PAD_ID, np.int32)
        before[lead] = START_ID
        before[lead + 1 : lead + len(own)] = own[:-1]
        inputs.append(np.lib.stride_tricks.sliding_window_view(before, CONTEXT)[::STRIDE])
        targets.append(goal.reshape(n, STRIDE))
        owner.append(np.full(n, k))
    return np.concatenate(inputs), np.concatenate(targets), np.concatenate(owner)


class Learner:
    """Adam from given weights; tables move only in the rows that were read, whose uses are counted."""

    def __init__(self, w: dict[str, np.ndarray], biases: list[np.ndarray], rate: float):
        self.rate, self.step = rate, 0
        # The learnt weights of the outputs are views, beside their biases.
        self.out = outputs(w, biases)
        self.w = {**w, **{f"out{k}": table[:, :WIDTH] for k, table in enumerate(self.out)}}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        self.uses = {k: np.zeros(len(v), np.int64) for k, v in w.items()}

    def learn(self, inputs: np.ndarray, targets: np.ndarray, progress: float) -> None:
        """One step; progress is the share of the work that is done, 0 to 1."""
        g = gradients(self.w, self.out, inputs, targets)
        self.step += 1
        rate = self.rate * max(0.02, min(1.0, 2 * (1 - progress)))
        rate *= math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for name, gradient in g.items():
            at, gradient = gradient if isinstance(gradient, tuple) else (slice(None), gradient)
            m, v = self.moments[name]
            here = m[at]
            here *= np.float32(0.9)
            here += np.float32(0.1) * gradient
            m[at] = here
            much = v[at]
            much *= np.float32(0.99)
            gradient *= gradient
            gradient *= np.float32(0.01)
            much += gradient
            v[at] = much
            # Whole tables are views, so nothing in place but the gradient's room from here on.
            np.sqrt(much, out=gradient)
            gradient += np.float32(1e-9)
            np.divide(here, gradient, out=gradient)
            gradient *= np.float32(rate)
            self.w[name][at] -= gradient
            self.uses[name][at] += 1


def least_windows() -> int:
    """Windows that one run of steps reads at least; smaller corpora are read several times."""
    return TRAINING_STEPS * BATCH


def train(ids: list[np.ndarray], biases: list[np.ndarray], seed: int = SEED) -> dict[str, np.ndarray]:
    """New weights, fitted in this process to every window of the texts, in one or more passes."""
    rng = np.random.default_rng(seed)
    w = new_weights(rng)
    if not ids:
        return w
    inputs, targets, _ = windows(ids)
    learner = Learner(w, biases, RATE)
    passes = -(-least_windows() // len(inputs))
    for k in range(passes):
        order = rng.permutation(len(inputs))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            learner.learn(inputs[some], targets[some], (k + at / len(order)) / passes)
    return learner.w


class Scorer:
    """Log10 probability of texts.  With one layer, what an input shows and asks is a sum of two rows."""

    def __init__(self, w: dict[str, np.ndarray], biases: list[np.ndarray]):
        self.out, self.asks, self.asks_place = outputs(w, biases), w["embed"], w["place"][CONTEXT - STRIDE :]
        self.seen, self.seen_place = w["embed"] @ projections(w), w["place"] @ projections(w)

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        """Hidden rows of windows; each ends with 1."""
        flat = np.ones((len(ids), STRIDE, WIDTH + 1), np.float32)
        for at in range(0, len(ids), CHUNK):
            # Padding wraps to the last row.
            rows = ids[at : at + CHUNK]
            seen = self.seen.take(rows, axis=0)
            seen += self.seen_place
            asks = self.asks.take(rows[:, CONTEXT - STRIDE :], axis=0)
            asks += self.asks_place
            np.add(asks, attend(seen, asks, rows)[1], out=flat[at : at + CHUNK, :, :WIDTH])
        return flat.reshape(-1, WIDTH + 1)

    def __call__(self, ids: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(ids))
        if not ids:
            return total
        inputs, targets, owner = windows(ids)
        for at in range(0, len(inputs), SCORED_WINDOWS):
            part = slice(at, at + SCORED_WINDOWS)
            logs = target_logs(self.out, self.hidden(inputs[part]), targets[part].ravel())
            np.add.at(total, owner[part], logs.reshape(-1, STRIDE).sum(axis=1, dtype=np.float64))
        return total / math.log(10)


def text_scores(w, biases, ids: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of every text, its windows in batches."""
    return Scorer(w, biases)(ids)


# ---- words and ids ---------------------------------------------------------------------------


class Codes(dict):
    """Numbers of words; a new word gets the next one as it is met."""

    def __init__(self):
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.names)
        self.names.append(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class EndedWords(WordIds):
    """Subword ids of words, each encoded once as it is met; the end is a word of one id."""

    def clear(self) -> None:
        super().clear()
        self.code = Codes()
        self.names = self.code.names
        self.uses = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keep the words met twice or more, half of the bound at most; codes become others."""
        kept = np.argsort(-self.uses, kind="stable")[: min(MET_WORDS // 2, np.count_nonzero(self.uses > 1))]
        names, uses = list(map(self.names.__getitem__, kept.tolist())), self.uses[kept] // 2
        ids, lengths = self.ids_of(kept)
        self.clear()
        self.code.of(names)
        self.uses, self.ids, self.start = uses, ids, np.append(0, np.cumsum(lengths))

    def met(self, words: list[bytes]) -> np.ndarray:
        """The codes of words, which hold until the next call."""
        if len(self.code) > MET_WORDS:
            self.forget_rare()
        codes = self.code.of(words)
        uses = np.bincount(codes, minlength=len(self.code))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        fresh = self.names[len(self.start) - 1 :]
        if fresh:
            found: list[list[int]] = []
            for group in calls(w.decode() for w in fresh):
                found += self.model.encode(group, num_threads=1)
            found = [ids if word else [END_ID] for word, ids in zip(fresh, found)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        return codes


class Encoder:
    """Subword ids of word lists; an end closes each list."""

    def __init__(self, path: str):
        self.words = EndedWords(path)

    def __call__(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        own = [self.words.ids_of(self.words.met([*words, END_WORD]))[0] for words in lists]
        return [ids.astype(np.int64) for ids in own]


class WordLogs:
    """Logarithms of the frequent words' counts by word code; not a number for all other words."""

    def __init__(self, words: WordIds, known: dict[bytes, int]):
        self.words, self.known = words, known
        self.generation, self.logs = -1, np.zeros(0)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.generation != self.words.generation:
            self.generation, self.logs = self.words.generation, np.zeros(0)
        fresh = self.words.names[len(self.logs) :]
        if fresh:
            counts = np.array([self.known.get(w, np.nan) for w in fresh], float)
            self.logs = np.concatenate([self.logs, np.log10(counts + 1)])
        return self.logs[codes]


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each id, the most frequent first; the vocabulary has fewer ids than ranks."""
    ranks = np.empty(IDS, np.int64)
    ranks[np.lexsort((np.arange(IDS), -counts))] = np.arange(IDS)
    return ranks


def lower_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def ended_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, an end behind each text, and how many each text has with its end."""
    lists = [lower_words(text) for text in texts]
    for words in lists:
        words.append(END_WORD)
    return list(chain.from_iterable(lists)), np.fromiter(map(len, lists), np.int64, len(lists))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``c`` over whole texts, ends included; summed in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                for text in batch.column(0).to_pylist():
                    seen.update(lower_words(text))
                seen[END_WORD] += batch.num_rows
                if len(seen) > COUNTED_WORDS:
                    yield counted(seen)
                    seen = Counter()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode() for w in seen], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "c"])

    rows = docs.select("text").mapInArrow(count, "word string, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def subword_counts(counts: DataFrame, vocabulary_path: str) -> np.ndarray:
    """Counts of all ids in the training text, from its distinct words; IDS numbers at most."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_memory("lm:" + vocabulary_path, lambda: Encoder(vocabulary_path)).words
        total = np.zeros(IDS)
        for batch in batches:
            ids, lengths = words.ids_of(words.met([w.encode() for w in batch.column(0).to_pylist()]))
            total += np.bincount(ids, weights=np.repeat(batch.column(1).to_numpy(), lengths), minlength=IDS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["id", "c"])

    rows = counts.mapInArrow(encode, "id long, c double").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(IDS)
    total[rows["id"].to_numpy()] = rows["c"].to_numpy()
    return total


# ---- learning over all training text ---------------------------------------------------------


def round_ends(n_ids: float) -> list[float]:
    """Where the rounds end, as shares of the hash range; the first is at most a least run of steps."""
    ends = [1.0]
    while ends[-1] * n_ids > least_windows() * STRIDE:
        ends.append(ends[-1] / GROWTH)
    return ends[::-1]


def rows_of(w: dict[str, np.ndarray]) -> list[tuple[str, int, int]]:
    """Each table with the numbers of its first row and of the row behind its last one."""
    ends = np.cumsum([len(table) for table in w.values()]).tolist()
    return list(zip(w, [0, *ends[:-1]], ends))


MOVES = "slot int, task int, uses long, moved binary"


def moves(w, learnt, uses, task: int) -> Iterator[pa.RecordBatch]:
    """How far the used rows of each table have moved."""
    for name, first, _ in rows_of(w):
        used = np.flatnonzero(uses[name])
        if len(used):
            moved = (learnt[name][used] - w[name][used]).reshape(len(used), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used + first, pa.int32()),
                    pa.array(np.full(len(used), task), pa.int32()),
                    pa.array(uses[name][used], pa.int64()),
                    pa.array([row.tobytes() for row in moved], pa.binary()),
                ],
                names=["slot", "task", "uses", "moved"],
            )


def mean_moves(rows: DataFrame) -> DataFrame:
    """The mean move of each row, weighted by its uses; tasks are added in their order."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total, n, done = None, None, 0, []
        for batch in batches:
            for at, uses, moved in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if at != slot:
                    done += [(slot, (total / n).astype(np.float32).tobytes())] if n else []
                    slot, total, n = at, 0.0, 0
                total, n = total + uses * np.frombuffer(moved, np.float32).astype(float), n + uses
        done += [(slot, (total / n).astype(np.float32).tobytes())] if n else []
        slots, means = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int32()), pa.array(means, pa.binary())], names=["slot", "moved"]
        )

    dealt = rows.repartition(SUM_TASKS, "slot").sortWithinPartitions("slot", "task")
    return dealt.mapInArrow(mean, "slot int, moved binary")


def id_lists(column: pa.Array) -> list[np.ndarray]:
    """The ids of each text, kept as two bytes each; Spark then moves a text as one value."""
    return [np.frombuffer(own, np.int16) for own in column.to_pylist()]


def learn_first(texts: DataFrame, biases: list[np.ndarray], memory: str) -> DataFrame:
    """The moves of new weights over a text table that one task can hold."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(memory)
        ids = [own for batch in batches for own in id_lists(batch.column(0))]
        if ids:
            w = new_weights(np.random.default_rng(SEED))
            yield from moves(w, train(ids, biases), {k: np.ones(len(v), np.int64) for k, v in w.items()}, 0)

    # In the order of their hashes, as the rows come by a shuffle.
    return texts.repartition(1).sortWithinPartitions("order", "ids").select("ids").mapInArrow(learn, MOVES)


def learn_more(texts: DataFrame, w, biases: list[np.ndarray], task_windows: float, memory: str) -> DataFrame:
    """Each task's moves over all windows of its texts, each read once."""
    shared = texts.sparkSession.sparkContext.broadcast((w, biases))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(memory)
        w, biases = shared.value
        task = TaskContext.get().partitionId()
        rng = np.random.default_rng([SEED, task])
        learner = Learner({k: v.copy() for k, v in w.items()}, biases, LATER_RATE)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = n_done = 0

        def learn_held() -> None:
            nonlocal n_held, n_done
            inputs, targets = map(np.concatenate, zip(*held))
            order = rng.permutation(len(inputs))
            for at in range(0, len(order), LATER_BATCH):
                some = order[at : at + LATER_BATCH]
                learner.learn(inputs[some], targets[some], min(1.0, (n_done + at) / task_windows))
            n_done += len(inputs)
            held.clear()
            n_held = 0

        for whole in batches:
            for batch in slices(whole, 1 << 18):
                inputs, targets, _ = windows(id_lists(batch.column(0)))
                held.append((inputs, targets))
                n_held += len(inputs)
                if n_held >= MIXED_WINDOWS:
                    learn_held()
        if held:
            learn_held()
        yield from moves(w, learner.w, learner.uses, task)

    return texts.select("ids").mapInArrow(learn, MOVES)


def learn(coded: DataFrame, biases: list[np.ndarray], n_ids: float, memory: str) -> dict[str, np.ndarray]:
    """Weights from all windows of ``ids``; ``order`` deals the texts to rounds.  Workers need no ``memory`` here."""
    w = new_weights(np.random.default_rng(SEED))
    unit = F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53))
    start = 0.0
    for end in round_ends(n_ids):
        texts = coded.where((unit >= start) & (unit < end))
        if not start:
            found = learn_first(texts, biases, memory)
        else:
            n_windows = (end - start) * n_ids / STRIDE
            tasks = texts.rdd.getNumPartitions()
            if end < 1:
                # Few of the rows of every file: dealt anew, a least run of steps for each task.
                tasks = math.ceil(n_windows / least_windows())
                texts = texts.repartition(tasks)
            found = learn_more(texts, w, biases, n_windows / tasks, memory)
        tables = rows_of(w)
        w = {k: v.copy() for k, v in w.items()}
        rows = mean_moves(found).toArrow()
        for slot, moved in zip(rows["slot"].to_pylist(), rows["moved"].to_pylist()):
            name, first = next((name, first) for name, first, behind in tables if slot < behind)
            table = w[name]
            table[slot - first] += np.frombuffer(moved, np.float32).reshape(table.shape[1:])
        start = end
    return w


# ---- operator --------------------------------------------------------------------------------


def score(
    docs: DataFrame,
    held_out: Column,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    memory = "lm:" + vocabulary_path
    text = whole_text(text_column)
    source = docs.select(
        F.col(id_column).alias("id"),
        held_out.alias("held_out"),
        text.alias("text"),
        F.xxhash64(F.col(id_column), F.xxhash64(text)).alias("order"),
    )
    learnt = source.where(~F.col("held_out"))
    counts = written(word_counts(learnt), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    subwords = subword_counts(counts, vocabulary_path)
    ranks = ranks_of(subwords)
    biases = digit_biases(np.sort(subwords)[::-1])
    # At most 2 ** FREQUENT_BITS words can have this share of all tokens.
    frequent = counts.where(F.col("c") * (1 << FREQUENT_BITS) >= F.lit(max(1, n))).toArrow()
    known = {w.encode(): c for w, c in zip(frequent["word"].to_pylist(), frequent["c"].to_pylist())}
    shared = spark.sparkContext.broadcast((ranks.astype(np.int16), known))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = shared.value
        words = worker_memory(memory, lambda: Encoder(vocabulary_path)).words
        word_logs = WordLogs(words, known)
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                met, n_words = ended_words(batch.column(4).to_pylist())
                codes, rows = words.met(met), np.repeat(np.arange(len(n_words)), n_words)
                logs = word_logs(codes)
                rare = np.isnan(logs)
                n_known = np.bincount(rows[~rare], minlength=len(n_words))
                totals = np.bincount(rows[~rare], weights=logs[~rare], minlength=len(n_words))
                # A row's other words, each once with its count.
                others, times = np.unique(rows[rare] << 32 | codes[rare], return_counts=True)
                names = list(map(words.names.__getitem__, (others & 0xFFFFFFFF).tolist()))
                rest = pa.StructArray.from_arrays(
                    [pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())],
                    ["word", "times"],
                )
                ids, lengths = words.ids_of(codes)
                id_ends = np.cumsum(lengths)[np.cumsum(n_words) - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:4],
                        pa.array(n_words, pa.int64()),
                        pa.array(n_known, pa.int64()),
                        pa.array(totals, pa.float64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.searchsorted(others >> 32, np.arange(len(n_words) + 1)), pa.int32()), rest
                        ),
                        pa.array([own.tobytes() for own in np.split(ranks[ids], id_ends[:-1])], pa.binary()),
                    ],
                    names=coded_schema.names,
                )

    numbered = source.select("id", "held_out", "order", F.monotonically_increasing_id().alias("row"), "text")
    kinds = "n_tokens long, known long, logs double, rest array<struct<word:string,times:bigint>>, ids binary"
    coded_schema = T.StructType([*numbered.schema.fields[:4], *T.StructType.fromDDL(kinds).fields])
    coded = written(numbered.mapInArrow(encode, coded_schema), "lm-ids")
    weights = learn(coded.where(~F.col("held_out")).select("order", "ids"), biases, subwords.sum(), memory)
    model = spark.sparkContext.broadcast((weights, biases))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(memory)
        scorer = Scorer(*model.value)
        for whole in batches:
            for batch in slices(whole, 1 << 19):
                scores = pa.array(scorer(id_lists(batch.column(6))), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], scores], names=schema.names)

    plain = coded.select("id", "held_out", "row", "n_tokens", "known", "logs", "ids")
    schema = T.StructType([*plain.schema.fields[:6], T.StructField("score", T.DoubleType())])
    scored = written(plain.mapInArrow(compute, schema), "lm-scores")
    # Words outside the frequent ones: their counts come by a join, none of them is hot.
    rare = coded.select("row", F.inline("rest")).join(counts.hint("shuffle_hash"), "word").groupBy("row").agg(
        F.sum("times").alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_logs"),
    )
    none = F.lit(0)
    per_token = math.log10(n + (v + 1))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", none)).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )
