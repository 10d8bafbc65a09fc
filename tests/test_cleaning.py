import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.functions.parsing import parse_number_text, parse_time_text
from tripmill.operators import cleaning
from tripmill.schema import DISTANCE, DROPOFF, FARE, FEATURES, PICKUP, REASON, ROW_ID, Rules
from tripmill.sources.synthetic import synthetic_trips


def reasons(df, rules=Rules()):
    return [r[REASON] for r in cleaning.classify(df, rules).orderBy(ROW_ID).collect()]


def test_one_bad_row_keeps_its_identity(spark):
    trips = synthetic_trips(spark, 20).withColumn(
        DISTANCE, F.when(F.col(ROW_ID) == 0, 0.0).otherwise(F.col(DISTANCE))
    )
    good, bad, report = cleaning.validate(trips)
    assert good.count() == 19
    assert [r[ROW_ID] for r in bad.collect()] == [0]
    assert report["raw_rows"] == 20 and report["reasons"] == {"distance_out_of_range": 1}
    assert set(FEATURES) <= set(good.columns)


def test_missing_columns_are_all_named(spark):
    trips = synthetic_trips(spark, 3).drop(FARE, DROPOFF)
    with pytest.raises(ValueError, match=f"{FARE}, {DROPOFF}"):
        cleaning.classify(trips)


@pytest.mark.parametrize(
    ("column", "value", "reason"),
    [
        (FARE, None, "missing_or_nonfinite_amount_distance"),
        (FARE, float("inf"), "missing_or_nonfinite_amount_distance"),
        (FARE, float("nan"), "missing_or_nonfinite_amount_distance"),
        (FARE, -1.0, "charge_out_of_range"),
        (DISTANCE, 100.0, "speed_out_of_range"),
        (DISTANCE, 1e-100, "nonfinite_features"),
        (DROPOFF, "bad", "invalid_timestamp"),
        (DROPOFF, "2020-01-01 00:00:00", "duration_out_of_range"),
    ],
)
def test_single_faults(spark, column, value, reason):
    kind = "string" if column == DROPOFF else "double"
    trips = synthetic_trips(spark, 1).withColumn(column, F.lit(value).cast(kind))
    assert reasons(trips) == [reason]


def test_first_failure_wins(spark):
    trips = synthetic_trips(spark, 1).withColumns(
        {FARE: F.lit(-1.0), DISTANCE: F.lit(0.0), DROPOFF: F.lit("bad")}
    )
    assert reasons(trips) == ["invalid_timestamp"]


def test_limits_are_closed_and_open_as_stated(spark):
    start = "2025-01-01 00:00:00"
    rows = [
        (0, start, "2025-01-01 00:01:00", 1.0, 5.0, 6.0),
        (1, start, "2025-01-01 03:00:00", 150.0, 1000.0, 1500.0),
        (2, start, "2025-01-01 00:00:59.999", 1.0, 5.0, 6.0),
        (3, start, "2025-01-01 03:00:00.001", 1.0, 5.0, 6.0),
        (4, start, "2025-01-01 01:00:00", 100.0, 5.0, 6.0),
        (5, start, "2025-01-01 01:00:00", 100.1, 5.0, 6.0),
    ]
    schema = f"{ROW_ID} bigint, {PICKUP} string, {DROPOFF} string, {DISTANCE} double, {FARE} double, total_amount double"
    found = reasons(spark.createDataFrame(rows, schema))
    late, fast = "duration_out_of_range", "speed_out_of_range"
    assert found == [None, None, late, late, None, fast]


def test_time_column_types(spark):
    trips = synthetic_trips(spark, 2)
    with pytest.raises(ValueError, match="expected text or naive"):
        cleaning.classify(trips.withColumn(PICKUP, F.lit(123)))
    with pytest.raises(ValueError, match="time zone"):
        cleaning.classify(trips.withColumn(PICKUP, F.col(PICKUP).cast("timestamp")))
    assert reasons(trips.withColumn(PICKUP, F.lit(None))) == ["invalid_timestamp"] * 2
    dates = trips.withColumns(
        {PICKUP: F.lit("2025-01-01").cast("date"), DROPOFF: F.lit("2025-01-02").cast("date")}
    )
    assert reasons(dates) == ["duration_out_of_range"] * 2


def test_an_input_row_id_is_needed(spark):
    with pytest.raises(ValueError, match="row_id"):
        cleaning.classify(synthetic_trips(spark, 2).drop(ROW_ID))


def test_clock_changes_do_not_bend_durations(spark):
    """Naive times are local clock readings: no session zone may shift them."""
    previous = spark.conf.get("spark.sql.session.timeZone")
    rows = [(0, "2025-03-09 02:30:00", "2025-03-09 03:30:00", 5.0, 20.0, 25.0)]
    schema = f"{ROW_ID} bigint, {PICKUP} string, {DROPOFF} string, {DISTANCE} double, {FARE} double, total_amount double"
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = cleaning.classify(spark.createDataFrame(rows, schema)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", previous)
    assert row["duration_minutes"] == 60.0 and row["pickup_hour"] == 2


def test_time_text(spark):
    cases = {
        "2025-01-15 10:30:00": True,
        "2025-01-15T10:30:00": True,
        "2025-01-15 10:30:00.25": True,
        "2025-1-5 1:30:00": True,
        "2025-01-15": False,
        "2025-01-15 10:30": False,
        "2025-01-15 10:30:00Z": False,
        "2025-13-15 10:30:00": False,
        " 2025-01-15 10:30:00": False,
        "noon": False,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    found = {r["t"]: r["p"] is not None for r in df.select("t", parse_time_text(F.col("t")).alias("p")).collect()}
    assert found == cases


def test_number_text(spark):
    cases = {"1.5": 1.5, "-2e3": -2000.0, "+.5": 0.5, "7.": 7.0, "1.5d": None, " 1": None, "": None, "x": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    found = {r["t"]: r["p"] for r in df.select("t", parse_number_text(F.col("t")).alias("p")).collect()}
    assert found == cases


def test_features_do_not_depend_on_column_order(spark):
    trips = synthetic_trips(spark, 10)
    turned = trips.select(*reversed(trips.columns))
    first = cleaning.classify(trips).select(ROW_ID, *FEATURES).orderBy(ROW_ID).collect()
    assert first == cleaning.classify(turned).select(ROW_ID, *FEATURES).orderBy(ROW_ID).collect()


def test_written_table_and_report(spark, tmp_path):
    trips = synthetic_trips(spark, 30).withColumn(
        FARE, F.when(F.col(ROW_ID) % 10 == 0, -1.0).otherwise(F.col(FARE))
    )
    report = cleaning.write_classified(trips, str(tmp_path / "trips"))
    assert report["accepted_rows"] == 27 and report["reasons"] == {"charge_out_of_range": 3}
    assert cleaning.read_accepted(spark, str(tmp_path / "trips")).count() == 27
    bad = cleaning.read_rejected(spark, str(tmp_path / "trips"))
    assert sorted(r[ROW_ID] for r in bad.collect()) == [0, 10, 20]


def test_classification_is_evaluated_once(spark):
    """The acceptance filter stays above the generated columns instead of repeating them."""
    good = cleaning.accepted(cleaning.classify(synthetic_trips(spark, 5)))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert len(filters) == 1 and "CASE" not in filters[0]


def test_extra_columns_are_ignored(spark):
    trips = synthetic_trips(spark, 2).withColumn("vendor", F.lit("x"))
    assert "vendor" not in cleaning.classify(trips).columns
    assert isinstance(cleaning.classify(trips).schema[ROW_ID].dataType, T.LongType)


def test_a_source_is_read_once(spark):
    """Accepted rows, rejected rows, scores and the report all come from one pass over the source."""
    trips = synthetic_trips(spark, 50).withColumn(
        DISTANCE, F.when(F.col(ROW_ID) % 10 == 0, 0.0).otherwise(F.col(DISTANCE))
    )
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    good, bad, report = cleaning.validate(trips.mapInArrow(counted, trips.schema))
    assert (good.count(), bad.count(), good.count()) == (45, 5, 45)
    assert report["reasons"] == {"distance_out_of_range": 5}
    assert (report["raw_rows"], report["accepted_rows"], report["rejected_rows"]) == (50, 45, 5)
    assert read.value == 50


def test_counts_need_no_features(spark):
    """The plan behind row counts builds the reason and no time feature."""
    trips = synthetic_trips(spark, 5)
    counts = cleaning.account(cleaning.reasons(trips))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "SIN(" not in plan and "COS(" not in plan and "hour" not in plan
    full = cleaning.account(cleaning.classify(trips))
    assert counts.collect() == full.collect()


def test_validation_of_nothing(spark):
    good, bad, report = cleaning.validate(synthetic_trips(spark, 5).limit(0))
    assert good.count() == bad.count() == report["raw_rows"] == 0 and report["reasons"] == {}
