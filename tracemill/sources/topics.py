"""Event topics: JSON records by key, topic and partition, on Kafka or as files."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources.catalog import JOB_TOPIC, TASK_TOPIC, TOPIC_PARTITIONS, table_schema


def event_schema(name: str, fields: list[str] | None = None) -> T.StructType:
    """Schema of a topic's JSON records, all or some fields of the trace table."""
    return T.StructType(
        [T.StructField(f.name, f.dataType) for f in table_schema(name) if not fields or f.name in fields]
    )


def read_topic(
    spark: SparkSession,
    topic: str,
    fmt: str = "kafka",
    servers: str | None = None,
    path: str | None = None,
    **options: str,
) -> DataFrame:
    """A topic from its earliest record as a stream with a ``value`` column.

    ``fmt="kafka"`` needs the Kafka connector on the class path. ``fmt="text"``
    reads the folder that ``write_topic`` wrote, one JSON record per line; a folder with a
    manifest (``commit_in_order``) in the order of its commits.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        defaults = {
            "kafka.bootstrap.servers": servers,
            "subscribe": topic,
            "startingOffsets": "earliest",
        }
        return reader.options(**{**defaults, **options}).load()
    # Files that lie in folders by partition, and none that is left out for its age.
    defaults = {"recursiveFileLookup": "true", "maxFileAge": "36500d"}
    return reader.options(**{**defaults, **options}).load(f"{path}/topic={topic}")


def decode_events(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The typed fields of JSON records; a record that cannot be decoded is a row of NULLs."""
    return df.select(F.from_json(F.col(value).cast("string"), schema).alias("data")).select("data.*")


def decode_or_keep(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The typed fields of JSON records, ``broken`` and ``raw``.

    A record that isn't JSON, doesn't end, or has a field of another type is broken, as is a missing
    or blank one: its fields are NULL, and ``raw`` is its text. A record without fields is not."""
    corrupt = "_corrupt"
    while corrupt in schema.fieldNames():
        corrupt = f"_{corrupt}"
    text = F.col(value).cast("string")
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    data = F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    broken = F.col("data").isNull() | F.col(f"data.{corrupt}").isNotNull()
    rows = df.select(data.alias("data"), text.alias("raw")).withColumn("broken", broken)
    fields = [F.when(~F.col("broken"), F.col(f"data.{f}")).alias(f) for f in schema.fieldNames()]
    return rows.select(*fields, "broken", F.when(F.col("broken"), F.col("raw")).alias("raw"))


def _json(df: DataFrame, without: list[str]) -> Column:
    return F.to_json(F.struct(*[c for c in df.columns if c not in without]))


def encode_events(df: DataFrame, key: str = "job_id", keep: list[str] | None = None) -> DataFrame:
    """(key, value) of each event: the key as text, the event as a JSON object without
    its NULL fields. Columns in ``keep`` stay beside them instead of going into the object."""
    keep = keep or []
    return df.select(
        F.col(key).cast("string").alias("key"), _json(df, keep).alias("value"), *keep
    )


def route_events(
    df: DataFrame,
    n: int = TOPIC_PARTITIONS,
    key: str = "job_id",
    by: str = "time",
    keep: list[str] | None = None,
) -> DataFrame:
    """(topic, partition, key, value) of each event.

    An event with a task index belongs to the task topic. Partitioning by time
    spreads a job over all partitions; ``by="job_id"`` keeps its events in order.
    Fill the two tables before their union, or job events gain a task index.
    """
    topic = F.when(F.col("task_index").isNull(), JOB_TOPIC).otherwise(TASK_TOPIC)
    routed = df.withColumn("topic", topic).withColumn(
        "partition", F.pmod(F.col(by), F.lit(n)).cast("int")
    )
    keep = ["topic", "partition", *(keep or [])]
    encoded = encode_events(routed, key, keep)
    return encoded.select(*keep[:2], "key", "value", *keep[2:])


def write_topic(
    df: DataFrame,
    fmt: str = "text",
    path: str | None = None,
    servers: str | None = None,
    by: Sequence[str] = ("topic", "partition"),
    **options: str,
) -> None:
    """Write routed events to Kafka, or as lines of JSON below folders for ``by``."""
    if fmt == "kafka":
        columns = ["topic", "partition", "key", "value"]
        writer = df.select(*columns).write.format("kafka").option("kafka.bootstrap.servers", servers)
        writer.options(**options).save()
    else:
        writer = df.select(*by, "value").write.partitionBy(*by)
        writer.options(**options).text(path)


# Name and version of the list of files that Spark's file streams follow, and after
# how many commits one holds all files.
MANIFEST, VERSION, COMPACT = "_spark_metadata", "v1", 10


def commit_in_order(spark: SparkSession, folder: str) -> int:
    """Publish the data files below a folder that are in no manifest yet, in order of their paths.

    The manifest is the one that Spark's own file sink writes and its file source follows: readers
    see its files alone, and a stream takes them in the order of the times listed there, which rise
    with each file. So the order needs no modification times of the store, and a write that failed
    half-way is not seen. Touches no data; returns the number of files published."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    path = hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return 0
    log = hadoop.fs.Path(path, MANIFEST)
    commits = {int(f.getPath().getName().split(".")[0]): f.getPath() for f in fs.listStatus(log)} if fs.exists(log) else {}
    listed: dict[str, dict] = {}  # a row for each file
    for commit in sorted(commits):
        stream = fs.open(commits[commit])
        try:
            lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
        listed |= {e["path"]: e for e in map(json.loads, filter(None, lines[1:]))}
    files, walk = [], fs.listFiles(path, True)
    while walk.hasNext():
        files.append(walk.next())
    names = {f.getPath().toUri().toString(): f for f in files}
    top = len(fs.makeQualified(path).toUri().toString())
    seen = (n for n in sorted(names) if not any(part.startswith(("_", ".")) for part in n[top:].split("/")))
    new = [names[n] for n in seen if n not in listed]
    if not new and commits:
        return 0
    first = max([e["modificationTime"] for e in listed.values()], default=int(time.time() * 1000)) + 1
    added = [
        {"path": f.getPath().toUri().toString(), "size": f.getLen(), "isDir": False, "modificationTime": first + i,
         "blockReplication": f.getReplication(), "blockSize": f.getBlockSize(), "action": "add"}
        for i, f in enumerate(new)
    ]
    nth = max(commits, default=-1) + 1
    compact = nth % COMPACT == COMPACT - 1
    entries = [*(listed.values() if compact else ()), *added]
    out = fs.create(hadoop.fs.Path(log, f"{nth}.compact" if compact else str(nth)), False)
    try:
        out.write("\n".join([VERSION, *map(json.dumps, entries)]).encode())
    finally:
        out.close()
    return len(new)
