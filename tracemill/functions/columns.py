"""Scalar functions over trace columns. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1e6
MICROS_PER_HOUR = 3.6e9


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str, dtype: str = "double") -> Column:
    """Text to a number; blanks around it are ignored, anything else malformed is NULL."""
    return _column(c).try_cast(dtype)


def zero_if_missing(c: Column | str) -> Column:
    """A measure with NULL, blank or malformed taken as 0."""
    return F.coalesce(to_number(c), F.lit(0.0))


def seconds(c: Column | str) -> Column:
    """Microseconds to seconds as a double."""
    return _column(c) / F.lit(MICROS_PER_SECOND)


def event_time(c: Column | str) -> Column:
    """Microseconds to a timestamp, truncated to the second."""
    return F.timestamp_seconds(seconds(c).cast("long"))


def hour_bucket(c: Column | str) -> Column:
    """Hour number of a microsecond time since the start of the trace."""
    return F.floor(_column(c) / F.lit(MICROS_PER_HOUR)).cast("long")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(_column(a), _column(b))


def pct(a: Column | str, b: Column | str) -> Column:
    """a as a percentage of b."""
    return ratio(a, b) * 100
