"""Junk that makes up a tenth to a third of a band is rejected, and clean documents stay."""

import random

import public_tokenizers
import pytest

from tripmill.llm import fertility

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ("the of and water house market people river small large when under over town bread "
         "winter summer field stone paper letter morning evening garden window road bridge "
         "school doctor music colour story children mother father friend island forest").split()  # fmt: skip
MARKS = ("$$$", "&&&", "%%%", "###")


def text(rng, junk, n_words):
    words = rng.choices(WORDS, k=n_words)
    if junk:
        words = [w + rng.choice(MARKS) if rng.random() < 0.6 else w for w in words]
    return " ".join(words)


@pytest.mark.parametrize("percent", [5, 10, 20, 30])
def test_planted_junk_is_rejected(spark, percent):
    rng = random.Random(percent)
    rows = [(k, text(rng, k < 4 * percent, rng.randint(120, 900)), "en") for k in range(400)]
    # Rows that fail the base rules do not set the fences.
    rows += [(1000 + k, "$$$ &&&", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in fertility.quality_rules(docs, PIECES).collect()}
    assert not any(kept[k] for k in range(4 * percent))
    assert sum(kept[k] for k in range(4 * percent, 400)) >= 0.98 * (400 - 4 * percent)
    assert not any(kept[1000 + k] for k in range(300))
