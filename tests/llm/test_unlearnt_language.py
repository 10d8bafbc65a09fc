"""Texts in a language that no label names go; odd texts in a learnt one stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripmill.llm import byte_cnn

FINNISH = "Talo seisoo mäen päällä ja sen ikkunoista näkyy koko laakso. Lapset juoksivat rantaan katsomaan, kun laiva tuli satamaan aamulla. "
RUSSIAN = "Дом стоит на холме, и из его окон видна вся долина. Дети побежали к берегу посмотреть, как корабль входит в гавань. "
ITALIAN = "La casa si trova sulla collina e dalle sue finestre si vede tutta la valle. I bambini corsero alla riva per vedere la nave. "
PLANTED = {-1: FINNISH * 4, -2: RUSSIAN * 4, -3: ITALIAN * 4, -4: "12345 !!! ", -5: None, -6: ""}


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = spark.createDataFrame(list(PLANTED.items()), "doc_id long, text string")
    return own.unionByName(planted, allowMissingColumns=True)


def test_unlearnt_languages_go_and_learnt_ones_stay(spark, docs):
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").select("doc_id").collect()}
    assert not kept & set(PLANTED)
    own = {r["doc_id"] for r in docs.where("doc_id >= 0 and text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert len(own - kept) <= 0.005 * len(own)


def test_energy_and_unseen_bytes():
    net = byte_cnn.train(["abc def " * 60, "xyz uvw " * 60] * 4, ["a", "b"] * 4)
    predictor = byte_cnn.Predictor(net)
    seen = set(b"abc def xyz uvw ")
    assert all(predictor.unseen[k] == (k not in seen) for k in range(256))
    names, scores, energies = predictor.judged(["abc def " * 60, "ab", "жук" * 100, "7 " * 200, "", "qqq"])
    assert names[0] == "a" and np.isfinite(energies[0])
    assert energies[1] == np.inf
    assert energies[2] == energies[5] == -np.inf
    assert names[3] == names[4] == "und"


def test_training_pieces_come_from_anywhere(spark):
    text = "".join(chr(97 + k // 200 % 26) for k in range(40_000))
    rows = [(k, text, "xx") for k in range(60)] + [(100, "short text", "yy"), (101, None, "yy")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, labels = byte_cnn.training_sample(table, F.lit(True), "doc_id", "text", "lang")
    assert labels == ["xx"] * 60 + ["yy"] and sample[-1] == ["short text"]
    places = [text.index(p) for pieces in sample[:-1] for p in pieces]
    assert all(len(p) == byte_cnn.WINDOW_BYTES for pieces in sample[:-1] for p in pieces)
    assert len({p for pieces in sample[:-1] for p in pieces}) > 100 and max(places) > 4_000


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, score double")
    assert byte_cnn.identified(empty, *byte_cnn.fit_known(empty)).count() == 0
    one = spark.createDataFrame([(1, "nur ein Text", "de")], "doc_id long, text string, lang string")
    assert byte_cnn.identified(one, *byte_cnn.fit_known(one)).count() == 1
