"""Analyses of a cluster-usage trace. Each takes typed trace tables and returns a lazy DataFrame.

Defaults follow the established definitions, which count event rows and drop keys
without evictions; options give the stricter readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import hour_bucket, pct, ratio, seconds, zero_if_missing
from tracemill.operators import aggregate as agg
from tracemill.operators import pairs as pr
from tracemill.operators.clean import (
    events_in,
    events_of,
    require_fields,
    require_nonempty,
    within_trace,
)
from tracemill.operators.join import (
    join_counts,
    request_usage_correlation,
    scalar_row,
    task_requests,
    task_samples,
)
from tracemill.operators.order import sorted_by
from tracemill.operators.sequence import adjacent_pairs
from tracemill.sources.catalog import EVICT, FINISH, MACHINE_ADD, MACHINE_REMOVE, SCHEDULE, SUBMIT

EVENT = ["time", "job_id", "event_type"]
# An outlier lies above this many means; a listing shows this many rows;
# a histogram has this many bins.
OUTLIER_FACTOR = 2
LISTED = 10
BINS = 50


def machines_by_cpu(machine_events: DataFrame, distinct: bool = False) -> DataFrame:
    """ADD events per CPU capacity; ``distinct`` counts machines instead."""
    added = events_of(require_nonempty(machine_events, ["cpus"]), MACHINE_ADD)
    counts = agg.distribution(
        added.withColumnRenamed("cpus", "cpu_capacity"),
        "cpu_capacity",
        "machine_id" if distinct else None,
        alias="machine_count",
    )
    return sorted_by(counts, "cpu_capacity")


def jobs_by_class(job_events: DataFrame, distinct: bool = False) -> DataFrame:
    """Job events per scheduling class; ``distinct`` counts jobs instead."""
    rows = require_nonempty(job_events, ["scheduling_class"])
    counts = agg.distribution(
        rows, "scheduling_class", "job_id" if distinct else None, alias="job_count"
    )
    return sorted_by(counts, "scheduling_class")


def tasks_by_class(task_events: DataFrame, distinct: bool = False) -> DataFrame:
    """Task events per scheduling class; ``distinct`` counts tasks instead."""
    rows = require_nonempty(task_events, ["scheduling_class"])
    if distinct:
        rows = rows.withColumn("task", F.struct("job_id", "task_index"))
    counts = agg.distribution(
        rows, "scheduling_class", "task" if distinct else None, alias="task_count"
    )
    return sorted_by(counts, "scheduling_class")


def eviction_probability(task_events: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Share of EVICT among the task events of each scheduling class; classes without
    evictions appear only with ``keep_zero``."""
    rows = require_nonempty(task_events, ["scheduling_class"])
    counts = agg.count_if_by(rows, "scheduling_class", F.col("event_type") == EVICT)
    if not keep_zero:
        counts = counts.filter(F.col("matches") > 0)
    return sorted_by(
        counts.select("scheduling_class", ratio("matches", "total").alias("eviction_probability")),
        "scheduling_class",
    )


def job_locality(task_events: DataFrame) -> DataFrame:
    """Jobs whose tasks ran on one machine and on several, with percentages."""
    rows = require_fields(task_events, ["job_id", "machine_id"])
    jobs = agg.one_or_several(rows, "job_id", "machine_id")
    counts = agg.split_counts(jobs, "values", "single_machine_jobs", "multiple_machine_jobs")
    total = F.col("single_machine_jobs") + F.col("multiple_machine_jobs")
    return counts.select(
        "*",
        pct("single_machine_jobs", total).alias("percent_single_machine"),
        pct("multiple_machine_jobs", total).alias("percent_multiple_machine"),
    )


def request_vs_usage(
    task_events: DataFrame, task_usage: DataFrame, first_only: bool = False
) -> DataFrame:
    """Correlation of requested and used CPU and memory over all pairs of a task's
    events and usage samples; ``first_only`` takes each task's first request."""
    return request_usage_correlation(task_requests(task_events, first_only), task_samples(task_usage))


def usage_per_instant(task_usage: DataFrame) -> DataFrame:
    """CPU and memory in use per machine and start time, missing measures as 0."""
    rows = require_fields(task_usage, ["machine_id", "start_time"])
    return agg.sums_by(
        rows,
        ["machine_id", "start_time"],
        {
            "cpu_usage": zero_if_missing("cpu_rate"),
            "memory_usage": zero_if_missing("canonical_memory_usage"),
        },
    )


def peak_usage(task_usage: DataFrame) -> DataFrame:
    """Largest CPU and memory in use at one time, per machine."""
    return agg.max_by_key(
        usage_per_instant(task_usage),
        "machine_id",
        {"max_cpu_usage": "cpu_usage", "max_memory_usage": "memory_usage"},
    )


def machine_evictions(task_events: DataFrame) -> DataFrame:
    """EVICT events per machine."""
    rows = events_of(require_fields(task_events, ["machine_id", "event_type"]), EVICT)
    return agg.distribution(rows, "machine_id", alias="eviction_count")


def eviction_by_machine(
    task_events: DataFrame, task_usage: DataFrame, keep_zero: bool = False
) -> DataFrame:
    """Evictions and usage peaks per machine; machines without evictions only with ``keep_zero``."""
    peaks, evictions = peak_usage(task_usage), machine_evictions(task_events)
    joined = join_counts(peaks, evictions, "machine_id", "left" if keep_zero else "inner")
    return joined.select(
        "machine_id",
        F.coalesce("eviction_count", F.lit(0)).alias("eviction_count"),
        "max_cpu_usage",
        "max_memory_usage",
    )


def peaks_vs_evictions(
    task_events: DataFrame, task_usage: DataFrame, keep_zero: bool = False
) -> DataFrame:
    """Correlation over machines of evictions with peak CPU and with peak memory."""
    machines = eviction_by_machine(task_events, task_usage, keep_zero)
    return machines.agg(
        agg.pearson_of("eviction_count", "max_cpu_usage").alias("cpu_correlation"),
        agg.pearson_of("eviction_count", "max_memory_usage").alias("memory_correlation"),
    )


def power_lost(
    machine_events: DataFrame,
    tie: Sequence[str] = (),
    trace_only: bool = False,
) -> DataFrame:
    """CPU-hours lost to downtime, CPU-hours available, and the percentage.

    Downtime is a REMOVE directly followed by an ADD of the machine, weighed with the
    capacity on the REMOVE row. Available is the observed time times the sum over
    machines of their mean capacity at ADD. ``trace_only`` leaves out marker times.
    """
    rows = require_fields(machine_events, ["time", "machine_id", "event_type"])
    if trace_only:
        rows = within_trace(rows)
    rows = rows.withColumn("capacity", zero_if_missing("cpus"))
    downtime = adjacent_pairs(
        rows, "machine_id", MACHINE_REMOVE, MACHINE_ADD, tie=tie, carry=["capacity"]
    )
    lost = downtime.agg(
        F.coalesce(F.sum(F.col("capacity") * seconds("elapsed") / 3600), F.lit(0.0)).alias(
            "lost_cpu_hours"
        )
    )
    machines = rows.groupBy("machine_id").agg(
        F.avg(F.when(F.col("event_type") == MACHINE_ADD, F.col("capacity"))).alias("mean_capacity"),
        F.min("time").alias("first"),
        F.max("time").alias("last"),
    )
    hours = (seconds(F.max("last")) - seconds(F.min("first"))) / 3600
    total = machines.agg((hours * F.sum("mean_capacity")).alias("total_cpu_hours"))
    return scalar_row(lost, total).withColumn(
        "percent_lost", pct("lost_cpu_hours", "total_cpu_hours")
    )


def _job_pairs(job_events: DataFrame, start: int, end: int, first_only: bool, trace_only: bool):
    rows = require_fields(job_events, EVENT)
    if trace_only:
        rows = within_trace(rows)
    events = pr.pair_events(rows, start, end, first_only=first_only)
    return events, pr.pair_totals(events)


def _mean_row(totals: DataFrame, mean: str) -> DataFrame:
    return pr.pair_mean(totals).select(
        "pairs",
        F.col("mean").alias(mean),
        (F.col("mean") * OUTLIER_FACTOR).alias("threshold_seconds"),
    )


def _outliers(events: DataFrame, totals: DataFrame, name: str) -> DataFrame:
    threshold = pr.pair_mean(totals).select(F.col("mean") * OUTLIER_FACTOR * 1e6).scalar()
    longest = pr.longest_pairs(events, totals, LISTED, above=threshold)
    return longest.select(F.col("key").alias("job_id"), seconds("elapsed").alias(name))


def scheduling_latency(
    job_events: DataFrame, first_only: bool = False, trace_only: bool = False
) -> DataFrame:
    """Pairs of SUBMIT and SCHEDULE of a job, their mean latency and the outlier threshold."""
    _, totals = _job_pairs(job_events, SUBMIT, SCHEDULE, first_only, trace_only)
    return _mean_row(totals, "mean_latency_seconds")


def slow_scheduled_jobs(
    job_events: DataFrame, first_only: bool = False, trace_only: bool = False
) -> DataFrame:
    """The ten longest latencies above the threshold."""
    pairs = _job_pairs(job_events, SUBMIT, SCHEDULE, first_only, trace_only)
    return _outliers(*pairs, "latency_seconds")


def latency_by_hour(
    job_events: DataFrame,
    tie: Sequence[str] = (),
    per_job: bool = False,
    trace_only: bool = False,
) -> DataFrame:
    """Mean gap per hour between a SUBMIT and a SCHEDULE directly after it.

    By default neighbours are sought among the events of all jobs in the hour, so a
    gap may span two jobs; ``per_job`` seeks them within a job.
    """
    rows = events_in(require_fields(job_events, EVENT), [SUBMIT, SCHEDULE])
    if trace_only:
        rows = within_trace(rows)
    rows = rows.withColumn("hour", hour_bucket("time"))
    part = ["hour", "job_id"] if per_job else ["hour"]
    gaps = adjacent_pairs(rows, part, SUBMIT, SCHEDULE, tie=tie)
    means = agg.mean_by(gaps, "hour", "elapsed")
    return means.select("hour", seconds("mean").alias("mean_latency_seconds"))


def job_durations(
    job_events: DataFrame, first_only: bool = False, trace_only: bool = False
) -> DataFrame:
    """Pairs of SCHEDULE and FINISH of a job, their mean duration and the outlier threshold."""
    _, totals = _job_pairs(job_events, SCHEDULE, FINISH, first_only, trace_only)
    return _mean_row(totals, "mean_duration_seconds")


def duration_histogram(
    job_events: DataFrame, bins: int = BINS, first_only: bool = False, trace_only: bool = False
) -> DataFrame:
    """Histogram of job durations in seconds."""
    events, totals = _job_pairs(job_events, SCHEDULE, FINISH, first_only, trace_only)
    return pr.pair_histogram(events, totals, bins)


def long_jobs(
    job_events: DataFrame, first_only: bool = False, trace_only: bool = False
) -> DataFrame:
    """The ten longest durations above the threshold."""
    pairs = _job_pairs(job_events, SCHEDULE, FINISH, first_only, trace_only)
    return _outliers(*pairs, "duration_seconds")
