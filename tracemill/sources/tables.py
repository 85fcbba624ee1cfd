"""Scan of trace tables from headerless CSV parts, or from Parquet after one conversion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources.catalog import LAYOUT, table_schema

# Columns that give a row's place in the input: parts in name order, then file order.
POSITION = ["source_file", "source_block", "seq"]


def read_table(
    spark: SparkSession,
    name: str,
    path: str | list[str],
    fmt: str = "csv",
    glob: str | None = None,
    position: bool = False,
) -> DataFrame:
    """A trace table with named, typed columns from a file or a folder of parts.

    Malformed numbers and blank fields read as NULL. ``position=True`` adds the
    columns of ``POSITION``. A gzip part is one task however large it is, so for
    repeated use convert once: ``read_table(...).write.parquet(p)``, then
    ``fmt="parquet"``, which also prunes columns and pushes filters.
    """
    schema = table_schema(name)
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    if fmt == "csv":
        # The CSV reader takes only true/false as booleans; the files hold 0/1.
        stored = T.StructType(
            [
                T.StructField(f.name, T.StringType()) if f.dataType == T.BooleanType() else f
                for f in schema
            ]
        )
        df = reader.schema(stored).option("header", "false").csv(path)
    else:
        df = reader.schema(schema).format(fmt).load(path)
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema]
    if position:
        columns += [
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("source_block"),
            F.monotonically_increasing_id().alias("seq"),
        ]
    return df.select(*columns)


def write_table(df: DataFrame, name: str, path: str) -> None:
    """Write a trace table as headerless gzip CSV parts, the format ``read_table`` scans."""
    columns = [
        F.col(f.name).cast("int").alias(f.name) if f.dataType == T.BooleanType() else F.col(f.name)
        for f in table_schema(name)
    ]
    df.select(*columns).write.option("compression", "gzip").csv(path)


def convert_table(df: DataFrame, name: str, path: str, buckets: int = 64, table: str | None = None) -> DataFrame:
    """Write a trace table once as a table in the layout that the catalogue declares, and read it back.

    It is bucketed by the columns that its analyses group and join by, and sorted within a bucket, so
    these need no exchange. Two tables that are joined need the same ``buckets``; a bucket should
    hold some hundred MB. ``table`` is its name in the session's catalog."""
    by, order = LAYOUT[name]
    table = table or f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *by)  # one file for each bucket
    rows.write.format("parquet").option("path", path).bucketBy(buckets, *by).sortBy(*order).saveAsTable(table)
    return df.sparkSession.table(table)
