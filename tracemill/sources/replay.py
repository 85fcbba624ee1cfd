"""The replay feed: both event tables as one stream of records in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.clean import fill_missing, valid_time
from tracemill.sources.catalog import JOB_TOPIC, TASK_TOPIC, table_schema
from tracemill.sources.tables import POSITION
from tracemill.sources.topics import commit_in_order, route_events, write_topic

RANK = "topic_rank"


def union_events(job_events: DataFrame, task_events: DataFrame) -> DataFrame:
    """Both event tables with all columns of either, NULL where a table has none.
    ``topic_rank`` is 0 for job events and 1 for task events."""
    return job_events.withColumn(RANK, F.lit(0)).unionByName(
        task_events.withColumn(RANK, F.lit(1)), allowMissingColumns=True
    )


def replay_order(
    job_events: DataFrame, task_events: DataFrame, tie: Sequence[str] = POSITION
) -> DataFrame:
    """Both tables in one global order: time, job events first, then place in the input.

    The sort is range-partitioned on all of these, so an instant with very many
    events is spread over tasks too.
    """
    return union_events(job_events, task_events).orderBy("time", RANK, *tie)


def _feed(job_events: DataFrame, task_events: DataFrame, drop_untimed: bool = False) -> DataFrame:
    """Both tables with missing fields filled.

    An event without a time is filled like any other field: it gets time 0 and stands at
    the head of the feed. ``drop_untimed`` drops it before that."""

    def filled(name: str, df: DataFrame) -> DataFrame:
        return fill_missing(valid_time(df) if drop_untimed else df, table_schema(name))

    return union_events(filled("job_events", job_events), filled("task_events", task_events))


def _routed(feed: DataFrame, tie: Sequence[str]) -> DataFrame:
    """(topic, partition, key, value, sent, rank and tie columns); ``sent`` is the event's time."""
    return route_events(feed.withColumn("sent", F.col("time")), keep=["sent", RANK, *tie])


def event_replay(
    job_events: DataFrame, task_events: DataFrame, tie: Sequence[str] = POSITION, drop_untimed: bool = False
) -> DataFrame:
    """(topic, partition, key, value, time) of every event in replay order."""
    ordered = _feed(job_events, task_events, drop_untimed).orderBy("time", RANK, *tie)
    return _routed(ordered, tie).select(
        "topic", "partition", "key", "value", F.col("sent").alias("time")
    )


def write_replay(
    job_events: DataFrame,
    task_events: DataFrame,
    tie: Sequence[str] = POSITION,
    files: int | None = None,
    spans: int = 1,
    drop_untimed: bool = False,
    **sink: str,
) -> None:
    """Write the replay feed to its topics; ``sink`` as for ``write_topic``.

    As files, every task writes one range of time, for each topic a file in replay order,
    and a manifest publishes them in the order of their ranges. A stream takes files in that
    order, so with any number of files a batch no event is behind the watermark of the
    batches before, on any store. ``files`` is the number of ranges, by default as many as
    the shuffle has.

    On Kafka a task appends its range to every topic partition beside other tasks, so
    ``spans`` ranges of time with about as many events each are written one after the
    other; a bounded stream is complete if each is shorter than its lateness.
    """
    feed = _feed(job_events, task_events, drop_untimed)
    order = ["time", RANK, *tie]
    if sink.get("fmt") == "kafka":
        cuts = feed.approxQuantile("time", [i / spans for i in range(1, spans)], 0.001) if spans > 1 else []
        bounds = [None, *sorted(set(cuts)), None]
        for lo, hi in zip(bounds, bounds[1:]):
            span = feed if lo is None else feed.filter(F.col("time") >= lo)
            span = span if hi is None else span.filter(F.col("time") < hi)
            routed = _routed(span.repartitionByRange(*order), tie)
            write_topic(routed.sortWithinPartitions("topic", "partition", "sent", *tie), **sink)
        return
    ranges = feed.repartitionByRange(files, *order) if files else feed.repartitionByRange(*order)
    routed = _routed(ranges, tie).sortWithinPartitions("topic", "sent", RANK, *tie)
    write_topic(routed, by=["topic"], **sink)
    for topic in (JOB_TOPIC, TASK_TOPIC):
        commit_in_order(feed.sparkSession, f"{sink['path']}/topic={topic}")


def part_index(spark: SparkSession, path: str, time: str = "time", fmt: str = "parquet") -> DataFrame:
    """Least and greatest time of each part of a folder: file, least, greatest, rows. One pass over one column."""
    rows = spark.read.format(fmt).load(path).select(F.col("_metadata.file_path").alias("file"), time)
    return rows.groupBy("file").agg(
        F.min(time).alias("least"), F.max(time).alias("greatest"), F.count(F.lit(1)).alias("rows")
    )


def merge_parts(
    spark: SparkSession, index: DataFrame, order: Sequence[str], time: str = "time", fmt: str = "parquet", spans: int | None = None
) -> DataFrame:
    """The rows of parts that are each in order, or nearly, as one table in order of ``order``, which begins
    with ``time``: a task for each span of time, the spans one after the other.

    A span begins where parts begin, and reads only the parts that overlap it, with its times as a
    pushed filter. So rows are sorted within a span and move to no other task: what parts in order
    save is the exchange of all rows. ``spans`` joins spans that follow each other, by default none;
    the index has a row a part and comes to the driver. A task holds a span, so parts should have
    some hundred MB at most."""
    parts = index.select("file", "least", "greatest").filter(F.col("least").isNotNull()).collect()
    if not parts:
        raise ValueError("the index has no part with a time")
    starts = sorted({p["least"] for p in parts})
    step = -(-len(starts) // spans) if spans else 1
    bounds = [*starts[::step], None]
    schema = spark.read.format(fmt).load(parts[0]["file"]).schema
    # A union of sides that have one task each is one task too, unless a side has another number: this has none.
    merged = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    for lo, hi in zip(bounds, bounds[1:]):
        files = sorted(p["file"] for p in parts if p["greatest"] >= lo and (hi is None or p["least"] < hi))
        span = spark.read.schema(schema).format(fmt).load(files).filter(F.col(time) >= lo)
        span = span if hi is None else span.filter(F.col(time) < hi)
        merged = merged.unionByName(span.coalesce(1).sortWithinPartitions(*order))
    return merged
