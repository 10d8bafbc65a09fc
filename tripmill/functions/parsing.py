"""Lenient readers for time and amount columns: a bad value becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A cast alone is too generous (date-only text, missing seconds, a trailing zone, padded or
# type-suffixed numbers all pass), so the shape is checked first.
TIME_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,9})?$"
NUMBER_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]|[nN][aA][nN])$"


def parse_time_text(text: Column) -> Column:
    return F.when(text.rlike(TIME_TEXT), text.try_cast("timestamp_ntz"))


def parse_number_text(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def read_time(name: str, dtype: T.DataType) -> Column:
    """Naive clock time from text, dates, naive timestamps or an all-null column."""
    if isinstance(dtype, T.StringType):
        return parse_time_text(F.col(name))
    if isinstance(dtype, (T.TimestampNTZType, T.DateType, T.NullType)):
        return F.col(name).cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampType):
        raise ValueError(f"{name}: timestamps with a time zone are refused; give local clock time")
    raise ValueError(f"{name}: expected text or naive timestamps, found {dtype.simpleString()}")


def read_amount(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return parse_number_text(F.col(name))
    return F.col(name).try_cast("double")
