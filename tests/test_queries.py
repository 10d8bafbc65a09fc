"""Every registered query against its SQL on another engine."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()
SLOW = {"k_study", "size_sweep", "line_sweep", "batch_study"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(tuple(canonical(row[c]) for c in columns) for row in df.collect())
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(canonical(row[i]) for i in order) for row in relation.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_sql_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_is_lazy_and_stable(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["cluster", "size"]
    assert df.count() == 3


@pytest.mark.parametrize(
    ("table", "expected"),
    [("sf0.001", (904, 10, 20, 14, 12, 20, 16, 4)), ("sf0.01", (8990, 99, 189, 143, 109, 203, 230, 37))],
)
def test_fixture_counts(spark, table, expected):
    """Accepted rows, then rejections in rule order."""
    from tripmill.schema import REASONS

    folder = f"/root/testdata/{table}"
    counts = {r["rejection_reason"]: r["rows"] for r in QUERIES["reject_reasons"](spark, folder).collect()}
    accounting = QUERIES["row_accounting"](spark, folder).first()
    assert (accounting["accepted_rows"], *[counts[reason] for reason in REASONS]) == expected
    assert accounting["raw_rows"] == accounting["accepted_rows"] + accounting["rejected_rows"]
    assert accounting["rejected_rows"] == sum(counts.values())
