"""Every operator and stage on odd rows: nulls, empty and long texts, repeats, clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripmill.llm import attention_lm, byte_cnn, chat, fertility, mixture, secret_scan
from tripmill.llm import sharding, simhash, templates, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHING = ("size", "shard", "slot", "fp", "score", "lang_pred", "n_tokens", "text_key", "pattern",
            "id", "order", "row", "root", "taken", "band", "first_id", "h", "Text_Read")
LONG = "the quick brown fox jumps over the lazy dog near a river bank " * 4000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "b", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, LONG, "en", "a", len(LONG)),
    (5, "### $$$ 123", None, "a", 11),
    (None, "a text without an id that has some words in it", "en", None, 10),
    (6, "le petit chat est sur la table et le chien dort dans la maison", "fr", "b", 60),
    (6, "le petit chat est sur la table et le chien dort dans la maison", "fr", "b", 60),
    (7, "le petit chat est sur la table et le chien dort dans la maison", "fr", "a", 60),
    (7, "another text under an id that is taken already by a cat", "en", "a", 60),
    (8, "漢字 仮名交じり文 \U0001f600 é \x00   end", "en", "c", 20),
]


def clashing(df):
    return df.withColumns({name: F.lit("clash") for name in CLASHING})


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


def language(docs):
    return byte_cnn.predict(docs, byte_cnn.fit(docs, F.lit(True)))


def lm(docs):
    return attention_lm.score(docs, F.col("doc_id") % 2 == 0, PIECES)


PER_ROW = {
    "fertility": lambda docs: fertility.quality_rules(docs, PIECES),
    "byte_cnn": language,
    "simhash": simhash.components,
    "attention_lm": lm,
    "token_counts": lambda docs: token_counts.count_tokens(docs, BYTES),
    "mixture": mixture.mix_by_source,
    "secret_scan": secret_scan.scan,
    "sharding": sharding.shard_documents,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_row_per_row(odd, empty, name, monkeypatch):
    monkeypatch.setattr(attention_lm, "TRAINING_STEPS", 5)
    rows = PER_ROW[name](odd).collect()
    assert len(rows) == len(ROWS)
    key = "doc_id"
    assert sorted(str(r[key]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert PER_ROW[name](empty).count() == 0


def test_language_of_odd_rows(odd):
    found = [(r["doc_id"], r["text"], r["_lang_pred"], r["_score"]) for r in language(odd).collect()]
    for _, text, lang, score in found:
        if text is None or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang in ("en", "fr") and 0 < score <= 1


def test_simhash_of_texts_without_words(odd):
    found = {r["doc_id"]: r for r in simhash.components(odd).collect()}
    assert {found[k]["fingerprint"] for k in (1, 2, 3)} == {"0" * 16}
    assert {found[k]["component_id"] for k in (1, 2, 3)} == {1}
    assert simhash.deduplicate(odd).columns == odd.columns
    # Texts without words, the two French rows, and five texts of their own.
    assert simhash.deduplicate(odd).count() == 7


def test_shards_of_odd_rows(odd):
    rows = sharding.shard_documents(odd).collect()
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    assert sizes[1] == (8, 0) and sizes[2] == (8, 0)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_templates_with_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame(
        [(1, "le petit chat est sur la table et le chien dort dans la maison"), (2, None), (3, ""),
         (None, "jumps over the lazy dog near a river bank"), (1, "le petit chat est sur la table et le chien dort dans la maison")],
        "item_id long, text string",
    )
    pairs = templates.contaminated(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in pairs} == {(6, 1), (7, 1), (4, None)}
    assert templates.contaminated(empty, bench).count() == 0
    none = bench.limit(0)
    assert templates.contaminated(odd, none).count() == 0
    kept = templates.clean(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == len(ROWS) - 4


def test_stages_keep_columns(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, "some item that is in no text at all of these")], "item_id long, text string"
                          ).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns, name
            docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_chat_with_odd_rows(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "first"), (1, 1, "assistant", ""), (None, 0, "user", "x"),
            (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (3, None, "assistant", "\\<|end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {n: F.lit("clash") for n in ("conversation", "parts", "formatted", "loss", "piece")}
    )
    out = chat.read_back(chat.format_turns(df, "conv_id", "turn", "role", chat.text_parts(F.col("text"))), "conv_id")
    found = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in out.collect()}
    assert found == {1: (3, 0), None: (1, 0), 2: (2, 8), 3: (1, 8)}
    none = df.limit(0)
    assert chat.format_turns(none, "conv_id", "turn", "role", chat.text_parts(F.col("text"))).count() == 0
