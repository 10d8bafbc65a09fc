"""Quality rules from public vocabularies: fertility, byte fallback and token entropy.

Every document's words are encoded with a byte-fallback vocabulary, commas and full stops apart.  Three numbers follow:
characters per token, the share of tokens that are fallback bytes, and the entropy of the
document's tokens against what its length allows.  A byte-level vocabulary gives a second number of
characters per token.  Bands per language (the declared one, else the script of the letters) are
fences around the densest half of that language's documents that pass the base rules, and a
document outside a band is rejected.  Documents outside the fences are left out and the half is
sought again until nothing changes, so a large share of junk does not move them.  Entropy falls
with the length, so its fences are per doubling of the token count.  Fences are wider for texts of
few words only, so that short clean texts stay.

Nulls: a null text has no words and fails the base rules; a null language falls back to the
script.  An empty table gives an empty result; repeated rows give repeated results and weigh as
often in the bands; a table of one document has bands around that document.  A band without a
document that passes the base rules has no fences.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.llm.common import bounded_batches, slices, whole_text, worker_memory, written
from tripmill.llm.pieces import calls
from tripmill.llm.token_counts import library_counts

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
# First letter of each script that is told apart; Latin is all below the first.
SCRIPTS = (
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
)
BEYOND_LATIN = re.compile("[Ͱ-᷿Ⰰ-\U0010ffff]")
# Half widths of the densest half that a fence lies from its middle.
REACH = 5
# No fence is nearer to the middle than these (characters per token, share, share of entropy).
LEAST_WIDTH = {"chars_per_token": 0.05, "byte_chars_per_token": 0.05, "fallback_share": 0.05,
               "entropy_share": 0.08}
# Numbers of characters per token, and the tokens by which chance may move them.
PER_TOKEN = ("chars_per_token", "byte_chars_per_token")
CHANCE_TOKENS = 2
# Metrics with fences per doubling of the token count; ANY_LENGTH stands for those of the others.
BY_LENGTH = ("entropy_share",)
ANY_LENGTH = -1
# Texts of fewer words have wider fences.
SHORT_WORDS = 50
BYTE_VOCABULARY = "byte_bpe_50k.json"
GRID = 1000
REMEMBERED_WORDS = 800_000
# Commas and full stops are tokens of their own, so "word" and "word," are encoded once.
MARKS_TO_SPACE = bytes(32 if chr(k) in ",." else k for k in range(256))


def script_of(text: str) -> str:
    """The script of most letters; Latin for texts without letters."""
    far = BEYOND_LATIN.findall(text)
    if not far or 2 * len(far) < sum(map(str.isalpha, text)):
        return "latin"
    names = Counter(
        next((name for start, name in reversed(SCRIPTS) if ord(c) >= start), "latin")
        for c in far
        if c.isalpha()
    )
    return min(names, key=lambda name: (-names[name], name)) if names else "latin"


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that the text has twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    inside = np.zeros(len(words) + 1, np.int64)
    for at, window in enumerate(windows):
        if seen[window] > 1:
            inside[at] += 1
            inside[min(at + WINDOW, len(words))] -= 1
    return int((np.cumsum(inside[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


class WordIds:
    """Vocabulary ids of words, and their tokens in a byte vocabulary if asked, encoded once each."""

    def __init__(self, path: str, byte_path: str | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(k) for k in range(size)])
        self.marks = [self.model.piece_to_id(","), self.model.piece_to_id(".")]
        self.byte_counts = library_counts(byte_path) if byte_path else lambda words: [0] * len(words)
        self.generation = 0
        self.clear()

    def clear(self) -> None:
        """Forget all words; codes of an earlier generation mean nothing any more."""
        self.generation += 1
        self.code: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)
        self.byte_length = np.zeros(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        fresh = list(words - self.code.keys())
        if len(self.code) + len(fresh) > REMEMBERED_WORDS:
            self.clear()
            fresh = list(words)
        found: list[list[int]] = []
        byte_length: list[int] = []
        for group in calls(w.decode() for w in fresh):
            found += self.model.encode(group, num_threads=1)
            byte_length += self.byte_counts([" " + word for word in group])
        base = len(self.code)
        self.code.update((w, base + k) for k, w in enumerate(fresh))
        self.names += fresh
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, flat])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.byte_length = np.concatenate([self.byte_length, np.array(byte_length, np.int64)])

    def codes_of(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each word has."""
        begin = self.start[codes]
        length = self.start[codes + 1] - begin
        ends = np.cumsum(length)
        shift = np.repeat(begin - ends + length, length)
        return self.ids[np.arange(len(shift)) + shift], length

    def measure(self, pieces: list[bytes], marks: tuple[int, int]) -> tuple[int, int, int, float]:
        """Tokens, tokens of the byte vocabulary, fallback bytes, and entropy in bits; commas and
        full stops are one token each."""
        distinct, times = np.unique(self.codes_of(pieces), return_counts=True)
        ids, length = self.ids_of(distinct)
        seen = np.bincount(ids, weights=np.repeat(times, length), minlength=len(self.is_byte))
        seen[self.marks] += marks
        total = seen.sum()
        if not total:
            return 0, 0, 0, 0.0
        share = seen[seen > 0] / total
        byte_tokens = int((self.byte_length[distinct] * times).sum()) + sum(marks)
        return int(total), byte_tokens, int(seen[self.is_byte].sum()), float(-(share * np.log2(share)).sum())


METRICS = T.StructType(
    [T.StructField(n, T.LongType()) for n in
     ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces",
      "n_byte_pieces")]
    + [T.StructField("script", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in
       ("chars_per_token", "byte_chars_per_token", "fallback_share", "entropy_share")]
)


def measured(docs: DataFrame, vocabulary_path: str, byte_path: str, id_column: str, text_column: str,
             language_column: str) -> DataFrame:
    """Id, language and the metrics of every whole text."""
    bounded_batches(docs.sparkSession)
    source = docs.select(
        F.col(id_column).alias("id"),
        F.col(language_column).alias("language"),
        whole_text(text_column).alias("text"),
    )
    schema = T.StructType([source.schema["id"], source.schema["language"], *METRICS.fields])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory(f"fertility:{vocabulary_path}:{byte_path}",
                               lambda: WordIds(vocabulary_path, byte_path))
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(2).to_pylist()
                split = [text.encode().split() for text in texts]
                pieces = [text.encode().translate(MARKS_TO_SPACE).split() for text in texts]
                memory.learn({p for own in pieces for p in own})
                rows = []
                for text, words, own in zip(texts, split, pieces):
                    chars = len(text) - sum(map(text.count, WHITE))
                    marks = text.count(","), text.count(".")
                    tokens, byte_tokens, fallback, entropy = memory.measure(own, marks)
                    most = np.log2(tokens) if tokens > 1 else 1.0
                    rows.append(
                        (
                            len(words),
                            chars,
                            sum(map(text.count, SYMBOLS)),
                            duplicate_lines(text),
                            repeated_words(words),
                            tokens,
                            byte_tokens,
                            script_of(text),
                            chars / tokens if tokens else 0.0,
                            chars / byte_tokens if byte_tokens else 0.0,
                            fallback / tokens if tokens else 0.0,
                            float(entropy / most),
                        )
                    )
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow_fields)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns],
                                                 names=names)

    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
    arrow_fields = [pa.field(f.name, kinds[f.dataType]) for f in METRICS.fields]
    names = schema.names
    return source.mapInArrow(measure, schema)


def densest_half(v: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Ends of the shortest range that holds half of the rows; ``n`` counts the sorted values."""
    below = np.concatenate([[0], np.cumsum(n)])
    half = (below[-1] + 1) // 2
    # The first value with which a range from each value on has enough.
    last = np.searchsorted(below, below[:-1] + half) - 1
    begin = np.flatnonzero(last < len(v))
    ends = last[begin]
    best = int(np.argmin(v[ends] - v[begin]))
    return int(v[begin[best]]), int(v[ends[best]])


def robust_fence(v: np.ndarray, n: np.ndarray, least: float) -> tuple[float, float]:
    """Middle of the densest half and the distance of the fences; what lies outside is left out
    and the rest looked at again.  Fewer values remain each time, so this ends."""
    while True:
        low, high = densest_half(v, n)
        middle, reach = (low + high) / 2, max(REACH * (high - low) / 2, least)
        inside = np.abs(v - middle) <= reach
        if inside.all():
            return middle, reach
        v, n = v[inside], n[inside]


def fences(metrics: DataFrame) -> DataFrame:
    """Middle and reach of each metric for each band and length.

    Values are counted on a grid of thousandths first, so a band of any size leaves a bounded
    number of rows and the fences do not depend on the order of partial results.
    """
    values = [
        F.struct(
            (F.col("length") if m in BY_LENGTH else F.lit(ANY_LENGTH).cast("long")).alias("length"),
            F.lit(m).alias("metric"),
            F.round(F.col(m) * GRID).cast("long").alias("v"),
        )
        for m in LEAST_WIDTH
    ]
    long = metrics.where("n_pieces > 0").select("band", F.explode(F.array(*values)).alias("x"))
    counted = long.groupBy("band", "x.length", "x.metric", "x.v").count()

    def fence(rows: pa.Table) -> pa.Table:
        band, length, metric = (rows[c][0].as_py() for c in ("band", "length", "metric"))
        v, n = rows["v"].to_numpy(), rows["count"].to_numpy()
        order = np.argsort(v)
        middle, reach = robust_fence(v[order], n[order], LEAST_WIDTH[metric] * GRID)
        return pa.table({"band": [band], "length": [length], "metric": [metric],
                         "q": [[middle / GRID, reach / GRID]]})

    levels = counted.groupBy("band", "length", "metric").applyInArrow(
        fence, "band string, length long, metric string, q array<double>"
    )
    return levels.groupBy("band", "length").pivot("metric", list(LEAST_WIDTH)).agg(F.first("q"))


def in_band(metric: str, widening: Column) -> Column:
    fence = F.col(("e." if metric in BY_LENGTH else "f.") + metric)
    value, middle, reach = F.col("m." + metric), fence[0], fence[1] * widening
    if metric in PER_TOKEN:
        reach = reach + CHANCE_TOKENS * middle / F.greatest(F.col("n_pieces"), F.lit(1))
    return F.abs(value - middle) <= reach


def quality_rules(
    docs: DataFrame,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    byte_vocabulary_path: str | None = None,
) -> DataFrame:
    """Base counts, fertility metrics, the band a document falls under, and the verdicts."""
    byte_path = byte_vocabulary_path or public_tokenizers.path(BYTE_VOCABULARY)
    raw = measured(docs, vocabulary_path, byte_path, id_column, text_column, language_column)
    metrics = written(
        raw.withColumns(
            {
                "band": F.coalesce(F.col("language").cast("string"), F.col("script")),
                "length": F.floor(F.log2(F.greatest(F.col("n_pieces"), F.lit(1)))),
            }
        ),
        "fertility",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    widening = F.greatest(F.lit(1.0), F.sqrt(SHORT_WORDS / F.greatest(F.col("n_words"), F.lit(1))))
    levels = written(fences(metrics.where(~failed)), "fertility-fences")
    joined = (
        metrics.alias("m")
        .join(levels.where(F.col("length") == ANY_LENGTH).drop("length").alias("f"), "band", "left")
        .join(levels.where(F.col("length") != ANY_LENGTH).alias("e"), ["band", "length"], "left")
    )
    inside = {m: F.coalesce(in_band(m, widening), F.lit(False)) for m in LEAST_WIDTH}
    verdict = ~failed
    for column in inside.values():
        verdict = verdict & column
    return joined.select(
        F.col("m.id").alias(id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        verdict.alias("kept"),
        "band",
        *[F.col("m." + m).alias(m) for m in LEAST_WIDTH],
        *[column.alias(m + "_in_band") for m, column in inside.items()],
    )
