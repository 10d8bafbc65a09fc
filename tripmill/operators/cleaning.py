"""Validation, feature engineering and row accounting: one path for training and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tripmill.functions import features as fx
from tripmill.functions.parsing import read_amount, read_time
from tripmill.schema import AMOUNT_COLUMNS, REASON, REASONS, ROW_ID, TIME_COLUMNS, Rules
from tripmill.session import shared_folder
from tripmill.sources.readers import check_contract


def engineer(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse the five inputs and derive the features.  Works on batches and streams."""
    check_contract(df)
    if ROW_ID not in df.columns:
        raise ValueError("rows need a row_id: read files with scan(), others through number_rows()")
    types = {field.name: field.dataType for field in df.schema.fields}
    parsed = df.select(
        ROW_ID,
        *[read_time(name, types[name]).alias(name) for name in TIME_COLUMNS],
        *[read_amount(name, types[name]).alias(name) for name in AMOUNT_COLUMNS],
        *keep,
    )
    return (
        parsed.withColumns(
            {"duration_minutes": fx.duration_minutes(), "pickup_hour": fx.pickup_hour()}
        )
        .withColumns({"speed_mph": fx.speed_mph(), "fare_per_mile": fx.fare_per_mile()})
        .withColumns({"hour_sin": fx.hour_sin(), "hour_cos": fx.hour_cos()})
    )


def computed_once(df: DataFrame) -> DataFrame:
    """Keep later filters from being rewritten in terms of this table's inputs.

    A filter on a derived column is normally pushed below the projection by repeating the
    whole expression in it, so every feature would be evaluated several times per row.
    Filters do not move below a generator that produces their column.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def classify(df: DataFrame, rules: Rules = Rules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row, with the first rule it breaks (null when it is fine)."""
    reason = fx.first_failure(fx.rejection_tests(rules))
    return computed_once(engineer(df, keep).withColumn(REASON, reason))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col(REASON).isNull()).drop(REASON)


def rejected(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col(REASON).isNotNull())


def prepare(df: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    classified = classify(df, rules)
    return accepted(classified), rejected(classified)


def reasons(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The reason of every row and nothing else: no time feature or other field is built for counts."""
    reason = fx.first_failure(fx.rejection_tests(rules))
    return computed_once(engineer(df).select(reason.alias(REASON)))


def account(classified: DataFrame) -> DataFrame:
    """One row: raw = accepted + rejected.  Needs the reason column only."""
    return classified.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col(REASON).isNull()).alias("accepted_rows"),
        F.count_if(F.col(REASON).isNotNull()).alias("rejected_rows"),
    )


def rejection_counts(classified: DataFrame) -> DataFrame:
    return rejected(classified).groupBy(REASON).agg(F.count(F.lit(1)).alias("rows"))


def _report(observed: dict, rules: Rules) -> dict:
    counts = {reason: observed[reason] for reason in REASONS if observed[reason]}
    bad = sum(counts.values())
    return {
        "raw_rows": observed["raw_rows"],
        "accepted_rows": observed["raw_rows"] - bad,
        "rejected_rows": bad,
        "reasons": counts,
        "rules": rules.as_dict(),
    }


def with_outcome(classified: DataFrame) -> DataFrame:
    """The partition column of written trips."""
    outcome = F.when(F.col(REASON).isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
    return classified.withColumn("outcome", outcome)


def _write_once(df: DataFrame, out: str, rules: Rules) -> tuple[DataFrame, dict]:
    """Scan, classify, count and write in one job; the written table and the report.

    The counts are metrics of the writing tasks, so neither the source nor the table is read for them.
    """
    observation = Observation("rows by reason")
    classified = with_outcome(classify(df, rules)).observe(
        observation,
        F.count(F.lit(1)).alias("raw_rows"),
        *[F.count_if(F.col(REASON) == reason).alias(reason) for reason in REASONS],
    )
    classified.write.mode("overwrite").partitionBy("outcome").parquet(out)
    table = df.sparkSession.read.schema(classified.schema).parquet(out)
    return table, _report(observation.get, rules)


def write_classified(df: DataFrame, out: str, rules: Rules = Rules()) -> dict:
    """Accepted and rejected rows as partitions of one table, with the report."""
    return _write_once(df, out, rules)[1]


def validate(df: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, dict]:
    """Accepted rows, rejected rows and the report; the source is parsed and classified once.

    Both tables are read from a written intermediate, whatever is done with them later.
    """
    table, report = _write_once(df, shared_folder(df.sparkSession, "validated"), rules)
    good = table.filter("outcome = 'accepted'").drop("outcome", REASON)
    return good, table.filter("outcome = 'rejected'").drop("outcome"), report


def read_accepted(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).filter("outcome = 'accepted'").drop("outcome", REASON)


def read_rejected(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).filter("outcome = 'rejected'").drop("outcome")
