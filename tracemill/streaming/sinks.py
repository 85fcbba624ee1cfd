"""Sinks of windowed streams, and reading back the metric series."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tracemill.session import COUNTED, LOGGED, switched_off

# Label of the metric job, gauge names, and minutes shown.
METRIC_JOB = "spark_job_metrics"
METRICS = ["total_cpu_usage", "total_memory_usage"]
RANGE_MINUTES = 5
# Rows that the console shows of an update.
SHOWN = 20
# The hour in which a window ends; the series is in folders by it once it is compacted.
HOUR = "end_hour"


def start(
    writer: DataStreamWriter,
    checkpoint: str,
    available_now: bool = False,
    uncounted: SparkSession | None = None,
    snapshots: SparkSession | None = None,
) -> StreamingQuery:
    """Start a stream with a checkpoint, so that its state survives a restart.

    With ``uncounted``, its session, the progress doesn't tell how many rows the state has: to count
    them, the store looks up each row once more when it is written and when it goes.

    With ``snapshots``, its session, each batch saves the state's new files and no log of changes.
    Who reads the state then loads it as it is; of a log, all changes since the last snapshot are
    made again, those of rows long gone too. For streams of few large batches whose state is read."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    if uncounted is None and snapshots is None:
        return writer.start()
    switches = [switch for switch, given in ((COUNTED, uncounted), (LOGGED, snapshots)) if given]
    with switched_off(uncounted or snapshots, *switches):
        return writer.start()  # takes the settings as they are now


def console_sink(df: DataFrame, mode: str = "update") -> DataStreamWriter:
    """Print the first rows of each update, as Spark's console shows them.

    That sink takes all the rows it is given to the driver. So each task reads its rows to the end,
    which keeps the state whole, but hands on only as many as the console can show."""

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = SHOWN + 1  # by the one more the console tells that there are others
        for batch in batches:
            if left:
                head = batch.slice(0, left)
                left -= head.num_rows
                yield head

    few = df.mapInArrow(first_rows, df.schema)
    return few.writeStream.outputMode(mode).format("console").options(truncate=False, numRows=SHOWN)


def batch_sink(df: DataFrame, path: str, mode: str = "update") -> DataStreamWriter:
    """Write each batch of updates as Parquet; a batch run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return df.writeStream.outputMode(mode).foreachBatch(write)


def quarantine_sink(df: DataFrame, path: str) -> DataStreamWriter:
    """Write the rows of ``decode_or_keep`` as Parquet by batch, the broken ones apart from the others, in one pass."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("broken").parquet(f"{path}/batch_id={batch_id}")

    return df.writeStream.foreachBatch(write)


def latest_updates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last update per key among the batches that ``batch_sink`` wrote."""
    # A struct of the values would have all rows sorted; numbers one by one are kept in a hash table.
    values = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])


def to_metrics(df: DataFrame, metrics: Sequence[str] = METRICS, job: str = METRIC_JOB) -> DataFrame:
    """Windowed results as one row (job, metric, machine_id, value, window_end) per gauge,
    without those that have no value."""
    gauge = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    )
    return (
        df.select(gauge.alias("gauge"), "machine_id", "window_end")
        .select(
            F.lit(job).alias("job"),
            "gauge.metric",
            F.col("machine_id").cast("string").alias("machine_id"),
            "gauge.value",
            "window_end",
        )
        .filter(F.col("value").isNotNull())
    )


def newest_gauges(metrics: DataFrame) -> DataFrame:
    """One value per gauge: that of its newest window."""
    return metrics.groupBy("job", "metric", "machine_id").agg(
        F.max_by("value", "window_end").alias("value"), F.max("window_end").alias("window_end")
    )


def metrics_sink(
    df: DataFrame, path: str, job: str = METRIC_JOB, push: Callable[[DataFrame, int], None] | None = None
) -> DataStreamWriter:
    """Write the gauges of each batch as Parquet, by batch and metric, in order of the window's end.

    A task writes at most one file for each metric; ``compact_metrics`` divides the series by
    hour. A batch run again replaces itself. ``push`` may also hand each batch's gauges
    to another system; it receives the rows just written, as a DataFrame.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        gauges = newest_gauges(to_metrics(batch, job=job))
        out = f"{path}/batch_id={batch_id}"
        rows = gauges.withColumn(HOUR, _hour_of("window_end")).sortWithinPartitions("metric", "window_end")
        rows.write.mode("overwrite").partitionBy("metric").parquet(out)
        if push:
            schema = gauges.withColumn(HOUR, F.lit("")).schema
            push(batch.sparkSession.read.schema(schema).parquet(out).select(*gauges.columns), batch_id)

    return df.writeStream.outputMode("update").foreachBatch(write)


def compact_metrics(spark: SparkSession, path: str, out: str) -> None:
    """The batches that ``metrics_sink`` wrote as one folder for each metric and hour, in few files."""
    written = spark.read.parquet(path)
    written.repartition("metric", HOUR).write.partitionBy("metric", HOUR).parquet(out)


def _hour_of(time: str) -> Column:
    return F.date_format(time, "yyyy-MM-dd-HH")


def metric_range(
    df: DataFrame, metric: str, minutes: int = RANGE_MINUTES, job: str | None = METRIC_JOB
) -> DataFrame:
    """The samples of one metric of a job whose window ends in the last minutes recorded.

    Of a series with hours, only the newest are read: folders, or parts of files by their statistics."""
    series = df.filter(F.col("metric") == metric)
    if job:
        series = series.filter(F.col("job") == job)
    back = F.expr(f"interval {minutes} minutes")
    recent = series
    if HOUR in df.columns:
        last_hour = series.agg(F.max(HOUR)).scalar()
        recent = series.filter(F.col(HOUR) == last_hour)
    newest = recent.agg(F.max("window_end")).scalar()
    if HOUR in df.columns:
        first = F.to_timestamp(last_hour, "yyyy-MM-dd-HH") - back
        series = series.filter(F.col(HOUR) >= F.date_format(first, "yyyy-MM-dd-HH"))
    return series.filter(F.col("window_end") >= newest - back)


def run_streams(
    spark: SparkSession, queries: Sequence[StreamingQuery], timeout: float | None = None
) -> None:
    """Run the streams until all have ended, or the timeout in seconds. When one fails, or
    at the timeout, the others are stopped; the failure is raised."""
    until = None if timeout is None else time.monotonic() + timeout
    try:
        for query in queries:
            while query.isActive and not any(q.exception() for q in queries):
                left = None if until is None else until - time.monotonic()
                if left is not None and left <= 0:
                    return
                query.awaitTermination(min(1.0, left) if left is not None else 1.0)
        for query in queries:
            if query.exception():
                raise query.exception()
    finally:
        for query in queries:
            query.stop()
        spark.streams.resetTerminated()
