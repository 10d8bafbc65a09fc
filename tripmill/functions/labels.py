"""Readable text for clusters and result series."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a mean hour is only named when the hours point the same way this strongly.
HOUR_CONCENTRATION = 0.4


def cluster_label(cluster: Column) -> Column:
    return F.concat(F.lit("Cluster "), cluster.cast("string"))


def circular_hour(mean_sin: Column, mean_cos: Column) -> Column:
    return F.pmod(F.atan2(mean_sin, mean_cos) * F.lit(12 / math.pi), F.lit(24.0))


def hour_concentration(mean_sin: Column, mean_cos: Column) -> Column:
    return F.hypot(mean_sin, mean_cos)


def profile_text(
    distance: Column, minutes: Column, speed: Column, mean_sin: Column, mean_cos: Column
) -> Column:
    """Measured means as one line; halves round to even, one decimal for miles."""
    clock = (F.bround(circular_hour(mean_sin, mean_cos)).cast("int") % 24).cast("int")
    timing = F.when(
        hour_concentration(mean_sin, mean_cos) >= HOUR_CONCENTRATION,
        F.format_string(" · pickup around %02d:00", clock),
    ).otherwise(F.lit(" · mixed pickup hours"))
    measured = F.format_string(
        "%.1f mi · %d min · %d mph average",
        distance,
        F.bround(minutes).cast("bigint"),
        F.bround(speed).cast("bigint"),
    )
    return F.concat(measured, timing)


def series_label(*parts: Column, streaming: Column | None = None, joiner: str = " · ") -> Column:
    label = F.concat_ws(joiner, *parts)
    if streaming is None:
        return label
    return F.concat(label, F.when(streaming, F.lit(f"{joiner}streaming")).otherwise(F.lit("")))
