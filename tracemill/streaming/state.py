"""What a stream holds in its state, read from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.session import COUNTED, switched_off


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a stream: operator, its name and number of partitions."""
    found = spark.read.format("state-metadata").load(checkpoint)
    return found.select(
        F.col("operatorId").alias("operator"), F.col("operatorName").alias("name"), F.col("numPartitions").alias("partitions")
    ).distinct()


def open_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The state of one operator after its last batch: ``key`` and ``value`` as structs, a row for each open group.

    A stream started with ``snapshots`` has it in files; otherwise each task makes the changes since the last
    snapshot again, one by one."""
    with switched_off(spark, COUNTED):  # a count would look up each row, or read all of them before
        found = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    return found.select("key", "value")


def open_windows(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Open windows of an operator that groups by window first: window_end and its number of groups."""
    state = open_state(spark, checkpoint, operator)
    end = F.col(f"key.{state.schema['key'].dataType.names[0]}.end")
    return state.groupBy(end.alias("window_end")).agg(F.count(F.lit(1)).alias("groups"))


def state_sizes(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """From a query's latest progress, a row an operator: operator, rows, bytes in memory, rows dropped as late."""
    operators = (query.lastProgress or {}).get("stateOperators", [])
    rows = [(i, o["numRowsTotal"], o["memoryUsedBytes"], o["numRowsDroppedByWatermark"]) for i, o in enumerate(operators)]
    return spark.createDataFrame(rows, "operator int, rows long, bytes long, dropped long")
