"""Durations are carried as exact BIGINT microseconds and converted once."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros_between(start, end) -> Column:
    """``end - start`` in microseconds; works for TIMESTAMP and TIMESTAMP_NTZ."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def micros_to_days(us) -> Column:
    return _c(us) / F.lit(float(DAY_US))


def micros_to_hours(us) -> Column:
    return _c(us) / F.lit(float(HOUR_US))


def to_ntz(col) -> Column:
    """Cast any timestamp to TIMESTAMP_NTZ (wall clock kept)."""
    return _c(col).cast("timestamp_ntz")
