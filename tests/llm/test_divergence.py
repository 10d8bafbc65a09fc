"""The divergence audit against its definition, term by term and pair by pair."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tripmill.llm import divergence, oracles

SCHEMA = "doc_id long, text string, lang string, source string"
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", TERMS.findall(lowered(text or ""))) for text, lang, source in rows]
    found = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if df[t] >= least)
        every = sum((counts[s] for s in counts), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s in counts:
            pairs = [(sum((p(counts[s], t) - p(counts[o], t)) ** 2 // p(counts[o], t) for t in kept), o)
                     for o in counts if o != s]
            terms = [((p(counts[s], t) - p(every, t)) ** 2 // p(every, t), t) for t in kept
                     if counts[s][t] and p(counts[s], t) > p(every, t)]
            for part, values, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                ordered = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                found += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ordered)]
    return sorted(found)


def audited(df, **options):
    columns = ("lang", "source", "part", "item", "value", "rank")
    return sorted(tuple(r[c] for c in columns) for r in divergence.audit(df, **options).collect())


ROWS = [
    ("Apple apple Banana cherry", "en", "a"), ("apple banana", "en", "a"), ("apple banana", "en", "a"),
    ("apple banana", "en", "b"), ("apple banana", "en", None), ("Über ÜBER über straße", "de", "a"),
    ("Über straße", "de", "b"), ("über Über straße x1y", "de", None), (None, "de", "c"), ("", None, "a"),
    ("\x00\t12 ,.", None, None), ("cherry cherry", "en", "b"), ("CHERRY kiwi", "en", "c"), ("alone", "fr", "a"),
    ("apple banana", "de", "a"), ("漢字 漢字", "zh", "a"), ("漢字", "zh", "b"), ("漢字 \U0001f600", "zh", "b"),
]


def test_against_the_definition(spark, monkeypatch):
    rows = ROWS + [("apple cherry kiwi " * 50, "en", f"s{k % 9}") for k in range(40)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA).withColumns(
        {n: F.lit("clash") for n in ("term", "n", "held", "copies", "digest", "Part", "p0", "value")}
    )
    assert audited(df) == plain(rows)
    # Counts and pairs handed on in small portions add up to the same.
    monkeypatch.setattr(divergence, "HELD_COUNTS", 2)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 1)
    monkeypatch.setattr(divergence, "SMALL_ROWS", 1)
    assert audited(df) == plain(rows)
    assert audited(df, term_ranks=1, least_documents=1) == plain(rows, 1, 1)


def test_a_text_is_collapsed_with_its_multiplicities(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], SCHEMA)
    texts = divergence.collapsed(df, "text", "lang", "source")
    found = {(r["lang"], r["text"]): sorted((h["source"], h["copies"]) for h in r["held"]) for r in texts.collect()}
    assert found["en", "apple banana"] == [("", 1), ("a", 2), ("b", 1)]
    assert found["de", "apple banana"] == [("a", 1)]
    assert len(found) == len({(r[1] or "", r[0] or "") for r in ROWS})


def test_empty_table(spark):
    assert audited(spark.createDataFrame([], SCHEMA)) == []


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    columns = "lang, source, part, item, value, rank"
    theirs = con.sql(f"SELECT {columns} FROM ({oracles.source_divergence()})").fetchall()
    assert audited(spark.read.parquet(f"{sf}/documents.parquet")) == sorted(theirs)


@pytest.mark.parametrize("count", [0, 3, 10**6])
def test_shares_are_exact(spark, count):
    row = spark.range(1).select(F.lit(count).alias("n"), F.lit(10**7).alias("m"), F.lit(77).alias("v"))
    assert row.select(divergence.share("n", "m", "v")).first()[0] == 1 + 10**9 * (count + 1) // (10**7 + 77)
