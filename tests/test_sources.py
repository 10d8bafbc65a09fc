import os
import hashlib

import pytest
from pyspark.sql import functions as F

from tripmill.schema import REQUIRED, RESULTS_SCHEMA, ROW_ID, SCORES_SCHEMA
from tripmill.session import shared_folder
from tripmill.sources import readers, writers
from tripmill.sources.synthetic import synthetic_trips


def test_only_known_formats(spark):
    with pytest.raises(ValueError, match="only .csv and .parquet"):
        readers.scan(spark, "/nowhere/trips.xlsx")


@pytest.mark.parametrize("suffix", ["csv", "parquet"])
def test_positions_replace_an_untrusted_id(spark, tmp_path, suffix):
    trips = synthetic_trips(spark, 50).withColumn(ROW_ID, F.lit(7)).coalesce(1)
    path = str(tmp_path / f"trips.{suffix}")
    getattr(trips.write.option("header", True), suffix)(path)
    found = readers.scan(spark, path)
    assert found.columns == [ROW_ID, *REQUIRED]
    assert sorted(r[ROW_ID] for r in found.select(ROW_ID).collect()) == list(range(50))


def test_positions_over_several_parquet_files(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    source = spark.range(1000).withColumnRenamed("id", "place")
    source.repartitionByRange(5, "place").sortWithinPartitions("place").write.parquet(path)
    placed = readers.with_row_position(spark.read.parquet(path), "parquet")
    assert placed.filter(F.col("place") != F.col(ROW_ID)).count() == 0


def test_positions_in_one_split_csv(spark, tmp_path):
    path = str(tmp_path / "split.csv")
    spark.range(20_000).withColumnRenamed("id", "place").coalesce(1).write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        raw = readers.read_raw(spark, path)
        assert raw.rdd.getNumPartitions() > 5
        placed = readers.with_row_position(raw, "csv")
        assert placed.filter(F.col("place").cast("bigint") != F.col(ROW_ID)).count() == 0
        assert placed.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_positions_of_rows_in_memory(spark):
    rows = spark.range(300).withColumnRenamed("id", "place").repartitionByRange(4, "place").persist()
    numbered = readers.number_rows(rows.withColumn(ROW_ID, F.lit(-1)))
    assert numbered.filter(F.col("place") != F.col(ROW_ID)).count() == 0


def test_upload_limits(spark, tmp_path):
    path = str(tmp_path / "upload.parquet")
    synthetic_trips(spark, 40).write.parquet(path)
    assert readers.bounded_scan(spark, path, max_rows=40).count() == 40
    with pytest.raises(ValueError, match="more than 39 rows"):
        readers.bounded_scan(spark, path, max_rows=39)
    with pytest.raises(ValueError, match="bytes"):
        readers.bounded_scan(spark, path, max_bytes=10)


def test_fingerprint(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2\n")
    row = readers.fingerprint(spark, str(tmp_path / "a.csv")).first()
    assert row["sha256"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    assert row["bytes"] == 8


def test_missing_table_is_empty(spark, tmp_path):
    table = readers.read_table(spark, str(tmp_path / "none.csv"), RESULTS_SCHEMA)
    assert table.count() == 0 and table.schema == RESULTS_SCHEMA
    assert readers.read_table(spark, str(tmp_path / "none.parquet"), SCORES_SCHEMA).isEmpty()


def test_csv_round_trip_with_arrays_and_booleans(spark, tmp_path):
    rows = [(2, 10, 1.5, 0.5, 1.0, 0.2, 0.8, [2, 8]), (3, 10, 1.0, None, 0.9, 0.1, 0.6, [1, 3, 6])]
    scores = spark.createDataFrame(rows, SCORES_SCHEMA)
    path = str(tmp_path / "scores.csv")
    writers.save_csv(scores, path)
    again = readers.read_table(spark, path, SCORES_SCHEMA)
    assert sorted(again.collect()) == sorted(scores.collect())
    flags = spark.createDataFrame([(True,), (False,)], "streaming boolean")
    assert [r[0] for r in writers.export_text(flags).collect()] == ["true", "false"]


def test_ragged_records(spark):
    done = spark.createDataFrame([("KMeans", 1.5)], "algorithm string, fit_seconds double")
    skipped = spark.createDataFrame([("KMeans", "skipped")], "algorithm string, detail string")
    both = writers.union_records([done, skipped])
    assert both.columns == ["algorithm", "fit_seconds", "detail"]
    assert both.filter("fit_seconds IS NULL").first()["detail"] == "skipped"


def test_attempts_are_kept_and_the_latest_is_current(spark, tmp_path):
    path = str(tmp_path / "attempts.parquet")
    for k in range(1, 11):
        writers.append_attempt(spark.createDataFrame([("a", k)], "name string, value int"), path, str(k))
    writers.append_attempt(spark.createDataFrame([("b", 1)], "name string, value int"), path, "09")
    # More rows of an attempt keep its number.
    writers.append_attempt(spark.createDataFrame([("c", 2)], "name string, value int"), path, "2")
    kept = writers.read_attempts(spark, path)
    assert kept.count() == 12
    assert {(r["attempt"], r["version"]) for r in kept.collect()} == {(str(k), k) for k in range(1, 11)} | {("09", 11)}
    current = {r["name"]: r["value"] for r in writers.latest(kept, ["name"]).collect()}
    # The tenth comes after the ninth.
    assert current == {"a": 10, "b": 1, "c": 2}


def test_half_a_write_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "attempts.parquet")
    writers.append_attempt(spark.createDataFrame([("a", 1)], "name string, value int"), path, "one")

    def lost(*args):
        raise RuntimeError("the driver is gone before the manifest")

    monkeypatch.setattr(writers, "manifest", lost)
    with pytest.raises(RuntimeError):
        writers.append_attempt(spark.createDataFrame([("a", 2), ("b", 2)], "name string, value int"), path, "two")
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 3
    assert [tuple(r) for r in writers.read_attempts(spark, path).select("name", "value").collect()] == [("a", 1)]
    # The next one starts over and is seen.
    writers.append_attempt(spark.createDataFrame([("a", 3)], "name string, value int"), path, "two")
    rows = writers.read_attempts(spark, path).orderBy("version").collect()
    assert [(r["value"], r["version"]) for r in rows] == [(1, 1), (3, 2)]


def test_positions_and_admission_read_no_data_twice(spark, tmp_path):
    """Rows per file come from a scan without columns, so only footers are read."""
    path = str(tmp_path / "trips.parquet")
    trips = synthetic_trips(spark, 60).drop(ROW_ID)
    trips.repartition(3).write.parquet(path)
    seen = []
    original = readers._block_offsets
    readers._block_offsets = lambda blocks, keys: seen.append(blocks) or original(blocks, keys)
    try:
        found = readers.scan(spark, path)
    finally:
        readers._block_offsets = original
    assert sorted(r[ROW_ID] for r in found.select(ROW_ID).collect()) == list(range(60))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
    with pytest.raises(readers.TooLarge) as refused:
        readers.bounded_scan(spark, path, max_rows=59)
    assert refused.value.rows == 60


def test_documents(spark, tmp_path):
    writers.save_document(spark, {"k": 3, "names": ["é"]}, str(tmp_path / "doc.json"))
    assert writers.load_document(spark, str(tmp_path / "doc.json")) == {"k": 3, "names": ["é"]}


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    one = synthetic_trips(spark, 100, 5).coalesce(1).orderBy(ROW_ID).collect()
    assert one == synthetic_trips(spark, 100, 5).repartition(7).orderBy(ROW_ID).collect()
    assert one != synthetic_trips(spark, 100, 6).orderBy(ROW_ID).collect()
    for row in one:
        assert 0.3 <= row["trip_distance"] < 20 and row["total_amount"] == row["trip_distance"] * 3 + 12


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    own = f"{named}/tripmill-{spark.sparkContext.applicationId}"
    assert first.startswith(f"{own}/x-") and first != second
    # The folder of the application exists, and goes when the driver ends.
    assert os.path.isdir(own)


def test_digest_of_a_whole_source(spark, tmp_path):
    import hashlib

    one = tmp_path / "one"
    one.mkdir()
    (one / "a.bin").write_bytes(b"first")
    digest = readers.source_digest(spark, str(one))
    assert digest == {"sha256": hashlib.sha256(b"first").hexdigest(), "bytes": 5, "files": 1}
    (one / "b.bin").write_bytes(b"second")
    both = readers.source_digest(spark, str(one))
    assert both["bytes"] == 11 and both["files"] == 2 and len(both["sha256"]) == 64
    (one / "b.bin").write_bytes(b"sec0nd")
    changed = readers.source_digest(spark, str(one))
    assert changed["sha256"] != both["sha256"] and changed["bytes"] == 11
