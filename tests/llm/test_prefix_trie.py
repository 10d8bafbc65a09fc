"""The trie against a plain one, on conversations that share, end inside one another and are odd."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tripmill.llm import oracles, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in found.items()}


def spliced(convs):
    def rebuilt(c):
        h = zlib.crc32(str(c).encode()) % 6
        return convs.get(c - c % 100, [])[:h] + convs[c][h:]

    return {c: rebuilt(c) for c in convs}


def plain(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv in sorted(convs):
        path = tuple(convs[conv])
        ends[path].append(conv)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(children[n]), leaves[n],
         saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n in members
    )


def collected(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def trie_of(turns):
    return prefix_trie.prefix_trie(turns.select("conv").distinct(), turns)


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_trie(spark, seed, monkeypatch):
    dice = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "BATCHES", ((1.0,), (0.3, 1.0), (0.1, 0.2, 0.5, 1.0))[seed])
    monkeypatch.setattr(prefix_trie, "CHUNK", (1024, 2, 3)[seed])
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", (1000, 1, 2)[seed])
    words = ["a", "bb", "", "ccc"]
    rows = []
    for conv in range(60):
        length = dice.choice([1, 2, 3, 3, 5, 9, 17, 40])
        # Long runs of one turn make conversations that end inside others.
        turns = ["a"] * length if conv % 3 else [dice.choice(words) for _ in range(length)]
        rows += [(conv, k, "user", text) for k, text in enumerate(turns)]
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    assert collected(trie_of(turns)) == plain(ordered(rows))


ODD = [
    (100, 1, "user", "x"), (100, None, None, None), (100, 1, "user", "x"), (100, 2, "assistant", "y" * 70000),
    (None, 0, "user", "nobody"), (101, 5, "user", "x"), (102, 0, "user", ""), (103, 0, None, "x"), (7, 0, "user", "x"),
    (7, 1, "user", "é\U0001f600"), (-3, 0, "user", "x"), (2**40, 0, "user", "x"), (108, 1, "user", "x"),
]


def test_odd_rows_and_splices(spark):
    names = ("pos", "s", "key", "depth", "Conv", "h", "base", "part", "at")
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in names})
    every, turns = prefix_trie.spliced(prefix_trie.ordered_turns(df))
    convs = ordered(ODD)
    # A truncated remainder, as in SQL, of the negative id.
    found = collected(prefix_trie.prefix_trie(every, turns))
    assert found == plain({c: t for c, t in spliced({**convs, 0: []}).items() if c in convs})


def test_nothing(spark):
    every, turns = prefix_trie.spliced(prefix_trie.ordered_turns(spark.createDataFrame([], SCHEMA)))
    assert prefix_trie.prefix_trie(every, turns).count() == 0
    # Conversations without turns end at the root.
    every = spark.createDataFrame([(4,), (9,)], "conv long")
    assert collected(prefix_trie.prefix_trie(every, turns)) == plain({4: [], 9: []})


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 40) for a in range(b)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.expr(prefix_trie.two_fattest("a", "b")).alias("f"))
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    theirs = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.conversation_trie()})").fetchall()
    turns = prefix_trie.ordered_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    mine = collected(prefix_trie.prefix_trie(*prefix_trie.spliced(turns)))
    assert mine == sorted(tuple(-1 if x is None else x for x in row) for row in theirs)
