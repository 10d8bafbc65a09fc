"""The attention weights come from the whole of every training text."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tripmill.llm import attention_lm

PIECES = public_tokenizers.path("piece_bpe_32k.model")
FILLER = "the cat sat on a mat and the dog ran to it while an old man read his book in a house by the sea".split()


def test_the_end_of_long_texts_is_learnt(spark, monkeypatch):
    """What follows what is told only behind the first 8,000 characters, and in every round."""
    monkeypatch.setattr(attention_lm, "TRAINING_STEPS", 20)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        start = " ".join(rng.choice(FILLER, 2600))
        assert len(start) > 8_000
        texts.append(start + " north south" * 300)
    pieces = attention_lm.Encoder(PIECES)([attention_lm.lower_words(t) for t in texts])
    assert len(attention_lm.round_ends(sum(map(len, pieces)))) > 1
    ordered, mixed = "north south " * 40, "north north south south " * 20
    rows = [*enumerate(texts), (-1, ordered), (-2, mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in attention_lm.score(docs, F.col("doc_id") < 0, PIECES).collect()}
    assert found[-1]["n_tokens"] == found[-2]["n_tokens"] == 81
    assert found[-1]["score"] > found[-2]["score"] + 20


def test_rounds_cover_the_hash_range_once():
    for n_ids in (0, 1_000, 10**7, 10**11):
        ends = attention_lm.round_ends(n_ids)
        assert ends[-1] == 1 and ends == sorted(ends)
        assert ends[0] * n_ids <= attention_lm.least_windows() * attention_lm.STRIDE


def test_moves_are_averaged_by_use(spark):
    rows = [(0, 0, 1, np.float32([3, 0])), (0, 1, 3, np.float32([-1, 4])), (7, 1, 2, np.float32([5, 6]))]
    df = spark.createDataFrame([(*r[:3], bytearray(r[3].tobytes())) for r in rows], attention_lm.MOVES)
    got = {r["slot"]: np.frombuffer(r["moved"], np.float32).tolist() for r in attention_lm.mean_moves(df).collect()}
    assert got == {0: [0.0, 3.0], 7: [5.0, 6.0]}
