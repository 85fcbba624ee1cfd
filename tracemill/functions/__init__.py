"""Column functions."""

from tracemill.functions.columns import (
    event_time,
    hour_bucket,
    pct,
    ratio,
    seconds,
    to_number,
    zero_if_missing,
)

__all__ = [
    "event_time",
    "hour_bucket",
    "pct",
    "ratio",
    "seconds",
    "to_number",
    "zero_if_missing",
]
