"""The random field against all tag sequences, its gradient, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.llm import registry, toxic_spans
from tripmill.llm.toxic_spans import Chains, Tagger, train


def chains_of(lengths):
    ends = np.array([x for n in lengths for x in [False] * n + [True]])
    return Chains(ends, np.zeros(len(ends), int))


def by_enumeration(emissions, steps):
    """Marginals, log norm and expected steps of one chain from all of its tag sequences."""
    to, back, stay, begin = steps
    total, toxic, taken = 0.0, np.zeros(len(emissions)), np.zeros(4)
    for tags in itertools.product((0, 1), repeat=len(emissions)):
        pairs = list(zip(tags, tags[1:]))
        counts = np.array([pairs.count((0, 1)), pairs.count((1, 0)), pairs.count((1, 1)), tags[0]])
        weight = np.exp(np.dot(tags, emissions) + counts @ np.array(steps))
        total += weight
        toxic += weight * np.array(tags)
        taken += weight * counts
    return toxic / total, np.log(total), taken / total


@pytest.mark.parametrize("seed", range(4))
def test_marginals_against_all_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 7, 5)
    chains = chains_of(lengths)
    emissions, steps = rng.normal(0, 2, lengths.sum()), rng.normal(0, 2, 4)
    toxic, norm, expected = chains.marginals(emissions, steps, gradient=True)
    parts = [by_enumeration(e, steps) for e in np.split(emissions, np.cumsum(lengths)[:-1])]
    assert np.allclose(toxic, np.concatenate([p[0] for p in parts]))
    assert np.isclose(norm, sum(p[1] for p in parts))
    assert np.allclose(expected, sum(p[2] for p in parts))
    assert np.allclose(chains.marginals(emissions, steps), toxic)


def test_long_sentences_are_cut_and_whole_texts_read():
    chains = chains_of([3 * toxic_spans.CHAIN_WORDS + 5])
    assert sorted(np.diff(np.append(np.flatnonzero(chains.first), len(chains.words)))) == [5, 64, 64, 64]


def made_up(n, seed):
    dice = random.Random(seed)
    plain = [a + b for a in ("lo", "ma", "ti", "re", "su", "ne") for b in ("ra", "do", "mi", "ka", "lu")]
    bad = ["vex" + x for x in ("o", "ula", "ing", "ard", "ette", "um")]
    texts, labels = [], []
    for k in range(n):
        words = [dice.choice(plain) for _ in range(dice.randint(5, 60))]
        label = int(k % 4 == 0)
        for _ in range(3 * label):
            words.insert(dice.randrange(len(words)), dice.choice(bad))
        texts.append(" ".join(words).capitalize() + ".")
        labels.append(label)
    return texts, labels


def test_held_out_texts_and_offsets():
    field = train(*made_up(400, 1))
    texts, labels = made_up(200, 2)
    scores, spans = Tagger(field).scores(texts)
    assert all((s >= 0.3) == bool(y) for s, y in zip(scores, labels))
    for text, label, found in zip(texts, labels, spans):
        marked = [text[s["start"] : s["end"]] for s in found]
        assert bool(marked) == bool(label)
        words = " ".join(marked).lower().split()
        assert all(w.startswith("vex") for w in words)
        assert len(words) == text.lower().count("vex")
    # A word never seen is told by its prefix, and far behind in a very long text too.
    long = "lora mami " * 40000 + "vexingly " * 3 + "ti."
    scores, spans = Tagger(field).scores([long, "", "Lora mami. \U0001f600 vexish vexly VEXO"])
    assert scores[0] >= 0.3 > scores[1] and scores[2] >= 0.3
    assert {long[s["start"] : s["end"]].split()[0] for s in spans[0]} == {"vexingly"}
    assert spans[2][0]["start"] == 13


def test_one_label_only():
    field = train(["a b c"] * 5, [0] * 5)
    assert Tagger(field).scores(["a", ""])[0] == [0.0, 0.0]
    assert Tagger(train([], [])).scores(["x"])[0] == [0.0]


def test_odd_tables(spark):
    texts, labels = made_up(120, 3)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "vexo vexo"), (500, None), (0, texts[0]), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {n: F.lit("clash") for n in ("score", "spans", "key", "label", "Order", "unit", "size")}
    )
    marks = [(k, y) for k, y in enumerate(labels)] + [(None, 1), (3, None), (4, 1), (4, 0), (9999, 1)]
    labelled = spark.createDataFrame(marks, "doc_id long, toxic int")
    field = toxic_spans.fit(docs, labelled, F.lit(True))
    found = toxic_spans.tag(docs, field).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 0}) == 1
    nothing = toxic_spans.fit(docs.limit(0), labelled, F.lit(True))
    assert {r["score"] for r in toxic_spans.tag(docs, nothing).collect()} == {0.0}
    assert toxic_spans.tag(docs.limit(0), field).count() == 0


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    monkeypatch.setattr(toxic_spans, "TRAINING_TEXTS", 30)
    args = (docs, labels, F.lit(True), "doc_id", "text", "toxic")
    assert sorted(toxic_spans.training_sample(*args)[1]) == [0] * 30 + [1] * 30
    monkeypatch.setattr(toxic_spans, "TRAINING_BYTES", 1000)
    assert sorted(toxic_spans.training_sample(*args)[1]) == [0] * 10 + [1] * 10


def test_query_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    found = registry.op13_toxic_spans(spark, big)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{big}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.3)
    clean = [r["score"] for r in rows if marks.get(r["doc_id"]) == 0 and r["held_out"]]
    toxic = [r["score"] for r in rows if marks.get(r["doc_id"]) == 1 and r["held_out"]]
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert wins > 0.8
    assert np.mean(np.array(clean) >= 0.3) < 0.1
