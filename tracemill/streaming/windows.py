"""Event-time windows. The same functions serve streams and static tables."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import event_time
from tracemill.operators.clean import within_trace

TIME = "event_time"
# Window length and slide, and how late an event may come.
LONG_WINDOW = "5 minutes"
SLIDE = "1 minute"
SHORT_WINDOW = "1 minute"
LATENESS = "5 minutes"


def with_event_time(df: DataFrame, time: str = "time", trace_only: bool = False) -> DataFrame:
    """The rows with their time as a timestamp. ``trace_only`` leaves out the marker times
    before and after the trace: the latter has no window, and would push a watermark past
    every event."""
    return (within_trace(df, time) if trace_only else df).withColumn(TIME, event_time(time))


def with_lateness(df: DataFrame, lateness: str | None = LATENESS, time: str = TIME) -> DataFrame:
    """Watermark ``lateness`` behind the newest event; None keeps state for ever."""
    return df.withWatermark(time, lateness) if lateness else df


def flatten_window(df: DataFrame) -> DataFrame:
    """Window start and end as columns in place of the struct."""
    return df.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *[c for c in df.columns if c != "window"],
    )


# Aggregates of a window by name: the kind and the column it is taken over.
Aggregates = dict[str, tuple[str, str]]


def _aggregate(kind: str, column: str) -> Column:
    return {"sum": F.sum, "avg": F.avg, "count": F.count}[kind](
        F.lit(1) if column == "*" else column
    )


def _interval(length: str) -> Column:
    """A duration as ``F.window`` takes it, with or without the word."""
    return F.expr("interval " + re.sub(r"(?i)^\s*interval\s+", "", length))


def _whole_slides(df: DataFrame, duration: str, slide: str) -> bool:
    """Whether slides fill a window; intervals are read by Spark, without a job."""
    length, step = df.sparkSession.sql("select 1").select(_interval(duration), _interval(slide)).first()
    return length % step == datetime.timedelta(0)


def hopping(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Aggregates,
    duration: str = LONG_WINDOW,
    slide: str = SLIDE,
    lateness: str | None = LATENESS,
) -> DataFrame:
    """Sums, averages and counts per overlapping window and key.

    A stream keeps state per window. A static table is first reduced to one row per
    slide and key, so that only these rows, not the events, are copied into every
    window that covers them.
    """
    if df.isStreaming or not _whole_slides(df, duration, slide):
        window = F.window(TIME, duration, slide).alias("window")
        grouped = with_lateness(df, lateness).groupBy(window, *keys)
        aggs = [_aggregate(*agg).alias(name) for name, agg in aggregates.items()]
        return flatten_window(grouped.agg(*aggs))

    columns = dict.fromkeys(c for _, c in aggregates.values() if c != "*")
    panes = (
        df.withColumn("_pane", F.window(TIME, slide))
        .groupBy(F.col("_pane.start").alias("_pane"), *keys)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(c).alias(f"_sum_{c}") for c in columns],
            *[F.count(c).alias(f"_count_{c}") for c in columns],
        )
    )

    earliest = F.col("_pane") - (_interval(duration) - _interval(slide))
    starts = F.sequence(earliest, F.col("_pane"), _interval(slide))
    grouped = panes.withColumn("window_start", F.explode(starts)).groupBy("window_start", *keys)
    totals = grouped.agg(*[_merged(*agg).alias(name) for name, agg in aggregates.items()])
    end = F.col("window_start") + _interval(duration)
    return totals.select("window_start", end.alias("window_end"), *keys, *aggregates)


def chained(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Aggregates,
    duration: str = LONG_WINDOW,
    slide: str = SLIDE,
    lateness: str = LATENESS,
) -> DataFrame:
    """The windows of ``hopping`` as two aggregates in a row: slides, and windows of closed slides.

    For streams in append mode: a window comes once, when the watermark has passed it. An event
    updates one row of state, that of its slide, and not one for each window that covers it; these
    are updated once a slide, when it is closed. Slides must fill a window."""
    if not _whole_slides(df, duration, slide):
        raise ValueError(f"{slide} doesn't fill {duration}")
    columns = dict.fromkeys(c for _, c in aggregates.values() if c != "*")
    slides = with_lateness(df, lateness).groupBy(F.window(TIME, slide).alias("_slide"), *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in columns],
        *[F.count(c).alias(f"_count_{c}") for c in columns],
    )
    window = F.window(F.window_time("_slide"), duration, slide).alias("window")
    return flatten_window(slides.groupBy(window, *keys).agg(*[_merged(*a).alias(n) for n, a in aggregates.items()]))


def _merged(kind: str, column: str) -> Column:
    """An aggregate of events from those of their slides."""
    if kind == "count":
        return F.sum("_rows" if column == "*" else f"_count_{column}")
    total = F.sum(f"_sum_{column}")
    return total if kind == "sum" else F.try_divide(total, F.sum(f"_count_{column}"))


def tumbling(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Aggregates,
    duration: str = SHORT_WINDOW,
    lateness: str | None = LATENESS,
) -> DataFrame:
    """Sums, averages and counts per window and key, windows end to end."""
    grouped = with_lateness(df, lateness).groupBy(F.window(TIME, duration).alias("window"), *keys)
    return flatten_window(grouped.agg(*[_aggregate(*a).alias(n) for n, a in aggregates.items()]))


USAGE: Aggregates = {
    "total_cpu_usage": ("sum", "cpu_request"),
    "total_memory_usage": ("sum", "memory_request"),
    "avg_cpu_request_per_task": ("avg", "cpu_request"),
    "avg_memory_request_per_task": ("avg", "memory_request"),
}


def machine_usage(df: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """Requested CPU and memory per machine, in total and per task, in hopping windows."""
    return hopping(df, ["machine_id"], USAGE, lateness=lateness)


def closed_machine_usage(df: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The same, each window once it is closed, by way of slides."""
    return chained(df, ["machine_id"], USAGE, lateness=lateness)


def event_counts(df: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """Events per user and event type in hopping windows."""
    return hopping(df, ["user", "event_type"], {"event_count": ("count", "*")}, lateness=lateness)


def machine_totals(df: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """Requested CPU and memory per machine in tumbling windows."""
    aggregates = {
        "total_cpu_usage": ("sum", "cpu_request"),
        "total_memory_usage": ("sum", "memory_request"),
    }
    return tumbling(df, ["machine_id"], aggregates, lateness=lateness)
