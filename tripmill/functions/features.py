"""Trip features and validity tests as column expressions (all inside code generation)."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripmill.schema import AMOUNT_COLUMNS, DISTANCE, DROPOFF, FARE, FEATURES, PICKUP, REASONS
from tripmill.schema import TIME_COLUMNS, TOTAL, Rules

HOUR_ANGLE = 2 * math.pi / 24
LARGEST_DOUBLE = 1.7976931348623157e308
LARGEST_FLOAT = 3.4028234663852886e38
# The clock features are a sine and a cosine: finite whenever the pickup time is known.
UNBOUNDED_FEATURES = tuple(name for name in FEATURES if not name.startswith("hour_"))


def duration_minutes() -> Column:
    """Whole elapsed milliseconds as minutes.

    Naive timestamps are subtracted directly: functions that take zoned timestamps would cast
    through the session zone, where local times inside a clock change do not exist.
    """
    elapsed = (F.col(DROPOFF) - F.col(PICKUP)).cast("interval second").cast("decimal(18,6)")
    milliseconds = (elapsed * 1000).cast("bigint")
    return milliseconds / F.lit(60000.0)


def pickup_hour() -> Column:
    return F.hour(PICKUP)


def speed_mph() -> Column:
    return F.try_divide(F.col(DISTANCE) * 60, F.col("duration_minutes"))


def fare_per_mile() -> Column:
    return F.try_divide(F.col(FARE), F.col(DISTANCE))


def hour_sin() -> Column:
    return F.sin(F.col("pickup_hour") * HOUR_ANGLE)


def hour_cos() -> Column:
    return F.cos(F.col("pickup_hour") * HOUR_ANGLE)


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left | right, tests)


def any_null(names: Iterable[str]) -> Column:
    return any_of(F.col(name).isNull() for name in names)


def not_finite(value: Column, largest: float = LARGEST_DOUBLE) -> Column:
    # NaN sorts above every number, so one comparison covers NaN and both infinities.
    return ~F.coalesce(F.abs(value) <= F.lit(largest), F.lit(False))


def any_not_finite(names: Iterable[str]) -> Column:
    return any_of(not_finite(F.col(name)) for name in names)


def any_beyond_float32(names: Iterable[str]) -> Column:
    """Models work on single precision, so a value too large for it counts as not finite."""
    return any_of(not_finite(F.col(name).cast("float"), LARGEST_FLOAT) for name in names)


def outside_closed(name: str, low: float, high: float) -> Column:
    return ~F.col(name).between(F.lit(float(low)), F.lit(float(high)))


def outside_positive(name: str, high: float) -> Column:
    return (F.col(name) <= 0) | (F.col(name) > F.lit(float(high)))


def rejection_tests(rules: Rules) -> dict[str, Column]:
    """One test per reason.  Order matters: later tests assume the earlier ones passed."""
    tests = (
        any_null(TIME_COLUMNS),
        any_not_finite(AMOUNT_COLUMNS),
        outside_closed("duration_minutes", rules.min_minutes, rules.max_minutes),
        outside_positive(DISTANCE, rules.max_distance),
        outside_positive(FARE, rules.max_fare) | outside_positive(TOTAL, rules.max_total),
        F.col("speed_mph") > F.lit(float(rules.max_speed)),
        any_beyond_float32(UNBOUNDED_FEATURES),
    )
    return dict(zip(REASONS, tests, strict=True))


def first_failure(tests: dict[str, Column]) -> Column:
    """The name of the first test that holds, or null when none does."""
    names, conditions = list(tests), list(tests.values())
    chain = F.when(conditions[0], F.lit(names[0]))
    for name, condition in zip(names[1:], conditions[1:]):
        chain = chain.when(condition, F.lit(name))
    return chain
