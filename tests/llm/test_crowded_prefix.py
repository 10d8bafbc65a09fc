"""Fingerprints that share their leading bits: groups stay bounded and no link is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.llm import components, simhash


def plain_roots(fps):
    """The smallest fingerprint (signed) reachable by links of at most four bits."""
    values = np.array(fps, np.int64)
    root = values.copy()
    near = [np.flatnonzero(np.bitwise_count((values ^ v).view(np.uint64)) <= 4) for v in values]
    while True:
        new = np.array([root[n].min() for n in near])
        if np.array_equal(new, root):
            return dict(zip(fps, root.tolist()))
        root = new


@pytest.mark.parametrize("shared", [16, 56])
def test_a_third_under_one_prefix(spark, monkeypatch, shared):
    monkeypatch.setattr(simhash, "VARIANTS_PER_PREFIX", 200_000)
    monkeypatch.setattr(simhash, "MOST_VARIANTS", 300_000)
    rng = np.random.default_rng(shared)
    free = 64 - shared
    hot = {int(x) - (1 << 62) for x in rng.integers(0, 2**free - 1, 200, dtype=np.int64, endpoint=True)}
    hot |= {x ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for x in list(hot)[:40]
            for a, b, c in rng.integers(0, 63, (2, 3))}
    fps = sorted(hot | {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 2 * len(hot))} | {0, -1})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    groups = simhash.bounded_routes(df, 6)
    left = F.lit(2) - F.bit_count(
        F.expr("shiftrightunsigned(fp, 64 - bits)").bitwiseXOR(F.col("route"))
    )
    rest = F.lit(64) - F.col("bits")
    variants = F.when(left == 0, 1).when(left == 1, 1 + rest).otherwise(1 + rest + rest * (rest - 1) / 2)
    sizes = groups.groupBy("bits", "route").agg(F.sum(variants).alias("variants"), F.count("*").alias("rows"))
    assert sizes.where("bits < 64 and variants > 300000").count() == 0
    assert groups.agg(F.max("bits")).first()[0] > 6
    got = {r["node"]: r["component"] for r in components.smallest_labels(simhash.links(df, len(fps))).collect()}
    roots = plain_roots(fps)
    assert all(got.get(f, f) == roots[f] for f in fps)


def test_all_64_bits(spark, monkeypatch):
    """Groups that are never small enough end as single variants."""
    monkeypatch.setattr(simhash, "MOST_VARIANTS", 0)
    fps = [0, 3, 15, -1, -16, 1 << 40, (1 << 40) + 31, -(1 << 63)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    rows = simhash.bounded_routes(df, 61).collect()
    assert {r["bits"] for r in rows} == {64}
    groups = {}
    for r in rows:
        groups.setdefault(r["route"], []).append(r["fp"])
    met = set()
    for route, group in groups.items():
        own = np.sort(np.array(group, np.int64)).view(np.uint64)
        a, b = simhash.meetings(own, route % 2**64, 64)
        met |= {frozenset(p) for p in zip(own[a].view(np.int64).tolist(), own[b].view(np.int64).tolist())}
    near = {frozenset((x, y)) for x in fps for y in fps if ((x ^ y) % 2**64).bit_count() <= 4 and x != y}
    # Links to the first that meets in a variant are enough.
    assert {p for p in met if len(p) == 2} <= near and near
    linked = {f: f for f in fps}
    for _ in fps:
        for x, y in (tuple(p) for p in met if len(p) == 2):
            linked[x] = linked[y] = min(linked[x], linked[y])
    assert linked == plain_roots(fps)


def test_one_row_stays_with_a_map_column(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "q r s t u"), (3, None)], "doc_id long, text string")
    docs = docs.withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))
    kept = simhash.deduplicate(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3] and all(r["extra"] == {"k": r["doc_id"]} for r in kept)
