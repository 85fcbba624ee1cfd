"""The streaming jobs: topic to decoded events to windows.

Marker times before and after the trace are left out unless ``trace_only`` is false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.sources.catalog import JOB_TOPIC, TASK_TOPIC
from tracemill.sources.topics import decode_events, event_schema, read_topic
from tracemill.streaming.windows import (
    LATENESS,
    closed_machine_usage,
    event_counts,
    machine_totals,
    machine_usage,
    with_event_time,
)

# The fields the metric job decodes.
METRIC_FIELDS = ["time", "job_id", "machine_id", "cpu_request", "memory_request"]


def resource_usage_stream(
    spark: SparkSession, lateness: str | None = LATENESS, trace_only: bool = True, **source: str
) -> DataFrame:
    """Requested resources per machine in hopping windows, from the task topic."""
    events = decode_events(read_topic(spark, TASK_TOPIC, **source), event_schema("task_events"))
    return machine_usage(with_event_time(events, trace_only=trace_only), lateness)


def closed_usage_stream(
    spark: SparkSession, lateness: str = LATENESS, trace_only: bool = True, **source: str
) -> DataFrame:
    """The same windows for append mode, each once when it is closed; an event updates a row of state."""
    events = decode_events(read_topic(spark, TASK_TOPIC, **source), event_schema("task_events"))
    return closed_machine_usage(with_event_time(events, trace_only=trace_only), lateness)


def event_counts_stream(
    spark: SparkSession, lateness: str | None = LATENESS, trace_only: bool = True, **source: str
) -> DataFrame:
    """Events per user and type in hopping windows, from the job topic."""
    events = decode_events(read_topic(spark, JOB_TOPIC, **source), event_schema("job_events"))
    return event_counts(with_event_time(events, trace_only=trace_only), lateness)


def machine_metrics_stream(
    spark: SparkSession, lateness: str | None = LATENESS, trace_only: bool = True, **source: str
) -> DataFrame:
    """Requested resources per machine in tumbling windows, from the task topic."""
    schema = event_schema("task_events", METRIC_FIELDS)
    events = decode_events(read_topic(spark, TASK_TOPIC, **source), schema)
    return machine_totals(with_event_time(events, trace_only=trace_only), lateness)
