"""Rows behind the watermark: which windows they were lost to, beside the windows themselves.

A windowed stream drops what comes too late without a word. Here one stream gives both, its
windows and its rows, so both belong to the same batches, and the sink keeps of the rows those
that the windows have left out: by the watermark that Spark noted in the checkpoint for the
batch, not by one estimated from the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracemill.streaming.windows import LATENESS, LONG_WINDOW, SLIDE, TIME, _interval, with_lateness


def windows_and_rows(
    events: DataFrame, windows: Callable[[DataFrame], DataFrame], lateness: str = LATENESS
) -> DataFrame:
    """(window, row): the windows that ``windows`` makes of the events, and every event, as structs;
    in each row one of them is null. ``windows`` sets no watermark of its own."""
    marked = with_lateness(events, lateness)
    found = windows(marked)
    rows = marked.select(F.struct(*marked.columns).alias("row"))
    return found.select(F.struct(*found.columns).alias("window")).unionByName(rows, allowMissingColumns=True)


def _noted_watermark(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """Microseconds of the watermark that a batch began with, as its checkpoint has it; 0 before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets/{batch_id}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    stream = fs.open(path)
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    return 1000 * int(json.loads(lines[1])["batchWatermarkMs"])


def late_sink(
    df: DataFrame, path: str, checkpoint: str, duration: str = LONG_WINDOW, slide: str = SLIDE, time: str = TIME
) -> DataStreamWriter:
    """Write updates of windows and late rows of ``windows_and_rows`` as Parquet, by batch and kind.

    A late row has ``lost``, the number of its windows that had ended behind the watermark when it
    came; rows that lost none are not written, nor rows without a time, which are in no window. A batch run again replaces itself. ``checkpoint`` is
    the folder that the stream is started with."""
    length, step = df.sparkSession.sql("select 1").select(_interval(duration), _interval(slide)).first()
    micros, of_row = int(step.total_seconds() * 1e6), int(length / step)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Spark judges late rows by the watermark of the batch before: only that has closed windows.
        behind = _noted_watermark(batch.sparkSession, checkpoint, batch_id - 1) if batch_id else 0
        at = F.unix_micros(F.col(f"row.{time}"))
        first_end = at - F.pmod(at, F.lit(micros)) + micros
        closed = F.floor((F.lit(behind) - first_end) / micros).cast("int") + 1
        lost = F.when(F.col("row").isNotNull(), F.greatest(F.least(closed, F.lit(of_row)), F.lit(0)))
        rows = batch.withColumn("lost", lost).filter(F.col("window").isNotNull() | (F.col("lost") > 0))
        kind = F.when(F.col("window").isNotNull(), "window").otherwise("late")
        rows.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch_id={batch_id}")

    return df.writeStream.outputMode("update").foreachBatch(write)


def read_late(spark: SparkSession, path: str, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``late_sink`` wrote for a stream like ``schema``: updates of windows with their ``batch_id``, and late rows with ``lost``."""
    written = schema.select("*", F.lit(0).alias("lost"), F.lit(0).alias("batch_id"), F.lit("").alias("kind")).schema
    found = spark.read.schema(written).parquet(path)
    windows = found.filter("kind = 'window'").select("batch_id", "window.*")
    return windows, found.filter("kind = 'late'").select("row.*", "lost")
