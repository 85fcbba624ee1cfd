"""Queries of feeds, streams and stored forms: late and broken records, accounts of cleaning, closed and open
windows, parts merged in order, converted tables, stored distinct counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import hour_bucket
from tracemill.operators import aggregate as agg
from tracemill.operators import pairs as pr
from tracemill.operators.clean import account_rows, clean_with_account
from tracemill.plans import analyses as an
from tracemill.session import shared_folder
from tracemill.sources.adapters import Trace
from tracemill.sources.catalog import JOB_TOPIC, SCHEDULE, SUBMIT, TABLES, coverage, table_schema
from tracemill.sources.replay import merge_parts, part_index, union_events
from tracemill.sources.tables import convert_table
from tracemill.sources.topics import commit_in_order, decode_events, decode_or_keep, encode_events, event_schema, read_topic, write_topic
from tracemill.streaming import jobs, late, sinks, state
from tracemill.streaming import windows as win

# Events in a part that a query writes, and the least number of parts in each half of a feed.
PART_ROWS, PARTS = 1_000_000, 6
BATCHES, DELAY = 12, 3  # of the topic with late rows: files, and by how many a delayed row comes later


def _delayed_topic(spark: SparkSession, folder: str) -> str:
    """Job events in files by time, a file a batch, every tenth event three files late."""
    events = Trace(spark, folder).job_events
    lo, hi = (events.agg(f("time").alias("t")).scalar() for f in (F.min, F.max))
    batch = F.call_function("div", (F.col("time") - lo) * BATCHES, hi - lo + 1)
    batch = F.least(batch + F.when(F.col("event_id") % 10 == 0, DELAY).otherwise(0), F.lit(BATCHES - 1))
    rows = events.withColumn("batch", F.lpad(batch.cast("string"), 2, "0")).repartition("batch")
    path = shared_folder(spark, "delayed")
    lines = encode_events(rows.drop("event_id"), keep=["batch"]).withColumn("topic", F.lit(JOB_TOPIC))
    write_topic(lines, by=["topic", "batch"], path=path)
    commit_in_order(spark, f"{path}/topic={JOB_TOPIC}")
    return path


def _late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of a stream with late rows, and the rows with the number of windows they were lost to."""
    topic = read_topic(spark, JOB_TOPIC, fmt="text", path=_delayed_topic(spark, folder), maxFilesPerTrigger="1")
    events = win.with_event_time(decode_events(topic, event_schema("job_events")))
    both = late.windows_and_rows(events, lambda df: win.event_counts(df, lateness=None))
    out, checkpoint = shared_folder(spark, "late"), shared_folder(spark, "checkpoint")
    query = sinks.start(late.late_sink(both, out, checkpoint), checkpoint, available_now=True)
    sinks.run_streams(spark, [query])
    windows, rows = late.read_late(spark, out, both)
    windows = sinks.latest_updates(windows, ["window_start", "window_end", "user", "event_type"])
    rows = rows.select("time", "job_id", "user", "event_type", "lost")
    dropped = rows.agg(F.sum("lost")).scalar()
    return windows.unionByName(rows, allowMissingColumns=True).withColumn("dropped", dropped)


def _broken_records(spark: SparkSession, folder: str) -> DataFrame:
    """A topic with records that are cut off, no JSON, of another type or blank: the good and the broken ones."""
    events = encode_events(Trace(spark, folder).job_events, keep=["event_id"])
    n, job = F.col("event_id"), F.get_json_object("value", "$.job_id")
    value = (
        F.when(n % 17 == 0, F.left("value", F.lit(12)))
        .when(n % 19 == 0, F.concat(F.lit("not json "), n.cast("string")))
        .when(n % 23 == 0, F.concat(F.lit('{"time":"soon","job_id":'), job, F.lit("}")))
        .when(n % 29 == 0, "")
        .otherwise(F.col("value"))
    )
    path = shared_folder(spark, "broken")
    write_topic(events.select(F.lit(JOB_TOPIC).alias("topic"), value.alias("value")), by=["topic"], path=path)
    commit_in_order(spark, f"{path}/topic={JOB_TOPIC}")
    records = decode_or_keep(read_topic(spark, JOB_TOPIC, fmt="text", path=path), event_schema("job_events"))
    out = shared_folder(spark, "quarantine")
    sinks.run_streams(spark, [sinks.start(sinks.quarantine_sink(records, out), shared_folder(spark, "checkpoint"), available_now=True)])
    return spark.read.schema(records.schema).parquet(out).select(*records.columns)


def _rule_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """What the rules of cleaning did to job events as text, with blank rows, wrong times and wrong classes."""
    rows = Trace(spark, folder).job_events
    n = F.col("event_id")

    def given(c: str) -> Column:
        text = F.col(c).cast("string")
        wrong = {"time": F.when(n % 13 == 0, "soon").otherwise(text), "scheduling_class": F.when(n % 11 == 0, "x").otherwise(text)}
        return F.when(n % 7 == 0, " ").otherwise(wrong.get(c, text)).alias(c)

    rows = rows.select(*[given(c) for c in rows.columns if c != "event_id"])
    cleaned, account = clean_with_account(rows, table_schema("job_events"), ["time", "job_id", "event_type"], ["user"])
    cleaned.write.parquet(shared_folder(spark, "cleaned"))
    return account_rows(spark, account)


def _closed_usage(staged: Callable[[SparkSession, str], dict[str, str]], rounded: Callable) -> Callable:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        windows = jobs.closed_usage_stream(spark, **staged(spark, folder))
        out = shared_folder(spark, "closed")
        writer = sinks.batch_sink(windows, out, mode="append")
        sinks.run_streams(spark, [sinks.start(writer, shared_folder(spark, "checkpoint"), available_now=True)])
        return rounded(spark.read.parquet(out).drop("batch_id"))

    return run


def _open_windows(staged: Callable[[SparkSession, str], dict[str, str]]) -> Callable:
    """Windows that a stream holds after its last batch, with a watermark and without."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        streams = {}
        for lateness in (win.LATENESS, None):
            windows = jobs.event_counts_stream(spark, lateness, **staged(spark, folder))
            writer, checkpoint = sinks.batch_sink(windows, shared_folder(spark, "updates")), shared_folder(spark, "checkpoint")
            query = sinks.start(writer, checkpoint, available_now=True, uncounted=spark, snapshots=spark)
            streams[checkpoint] = (lateness is not None, query)
        sinks.run_streams(spark, [query for _, query in streams.values()])
        found = None
        for checkpoint, (watermark, _) in streams.items():
            held = state.open_windows(spark, checkpoint).agg(
                F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("groups"), F.lit(0)).alias("groups")
            )
            held = held.withColumn("watermark", F.lit(watermark))
            found = held if found is None else found.unionByName(held)
        return found

    return run


def _console(staged: Callable[[SparkSession, str], dict[str, str]]) -> Callable:
    """The console sink run over the topic: rows that it has read."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        counts = jobs.event_counts_stream(spark, **staged(spark, folder))
        query = sinks.start(sinks.console_sink(counts), shared_folder(spark, "checkpoint"), available_now=True)
        query.awaitTermination()
        shown = [p for p in query.recentProgress if "Console" in p["sink"]["description"]]
        sinks.run_streams(spark, [query])
        return spark.createDataFrame([(sum(p["numInputRows"] for p in shown),)], "rows_read long")

    return run


def _merged_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Parts in order of time, which overlap in pairs, merged: rows, neighbours out of order, and tasks that overlap."""
    t, order = Trace(spark, folder), ["time", "topic_rank", "event_id"]
    feed, path = union_events(t.job_events, t.task_events), shared_folder(spark, "parts")
    parts = max(PARTS, -(-t.events.count() // PART_ROWS))  # a half has as many rows as there are events
    for half in (0, 1):
        part = feed.filter(F.pmod("event_id", F.lit(2)) == half).repartitionByRange(parts, "time")
        part.sortWithinPartitions(*order).write.mode("append").parquet(path)
    merged = merge_parts(spark, part_index(spark, path), order)
    seen = merged.select(*order, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("nth"))
    before = F.lag(F.struct(*order)).over(Window.partitionBy("task").orderBy("nth"))
    tasks = seen.withColumn("before", before).groupBy("task").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("before") > F.struct(*order)).alias("out_of_order"),
        F.min(F.struct(*order)).alias("first"),
        F.max(F.struct(*order)).alias("last"),
    )
    overlaps = F.col("first") < F.lag("last").over(Window.orderBy("task"))  # a row a task
    return tasks.withColumn("overlaps", overlaps).agg(
        F.sum("rows").alias("rows"), F.sum("out_of_order").alias("out_of_order"), F.count_if("overlaps").alias("overlaps")
    )


def _converted(make: Callable[..., DataFrame], *names: str, rounded: Callable) -> Callable:
    """An analysis of tables that were converted to their declared layout."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = Trace(spark, folder)
        return rounded(make(*[convert_table(getattr(t, n), n, shared_folder(spark, n), buckets=8) for n in names]))

    return run


def _stored_distincts(spark: SparkSession, folder: str) -> DataFrame:
    """Users per event type over the even hours: from stored sketches of hours and types, and exact."""
    rows = Trace(spark, folder).job_events.withColumn("hour", hour_bucket("time"))
    path = shared_folder(spark, "sketches")
    agg.distinct_sketches(rows, ["hour", "event_type"], "user").write.parquet(path)
    stored = spark.read.parquet(path)
    of = F.col("hour") % 2 == 0
    told = agg.distinct_of_sketches(stored.filter(of), ["event_type"], "told")
    exact = rows.filter(of).groupBy("event_type").agg(F.count_distinct("user").alias("users"))
    near = (F.abs(F.col("told") - F.col("users")) <= 0.03 * F.col("users")).alias("within_3_percent")
    return exact.join(told, "event_type").select("event_type", "users", near)


def feed_queries(staged: Callable[[SparkSession, str], dict[str, str]], rounded: Callable) -> dict[str, Callable]:
    """``staged`` gives the options to read the staged topic, ``rounded`` the rows as they are compared."""
    return {
        "late_rows": lambda spark, folder: rounded(_late_rows(spark, folder)),
        "broken_records": _broken_records,
        "rule_accounts": _rule_accounts,
        "closed_usage_stream": _closed_usage(staged, rounded),
        "open_windows": _open_windows(staged),
        "console_stream": _console(staged),
        "catalogue_coverage": lambda spark, folder: coverage({n: getattr(Trace(spark, folder), n) for n in TABLES}),
        "replay_merged_parts": _merged_replay,
        "job_locality_converted": _converted(an.job_locality, "task_events", rounded=rounded),
        "scheduling_latency_converted": _converted(an.scheduling_latency, "job_events", rounded=rounded),
        "job_durations_converted": _converted(an.job_durations, "job_events", rounded=rounded),
        "request_vs_usage_converted": _converted(an.request_vs_usage, "task_events", "task_usage", rounded=rounded),
        "stored_distincts": _stored_distincts,
        "every_pair": lambda spark, folder: pr.event_pairs(
            pr.pair_events(Trace(spark, folder).job_events, SUBMIT, SCHEDULE), first_only=False
        ).withColumnRenamed("key", "job_id"),
    }
