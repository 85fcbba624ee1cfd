"""Every operator and analysis as a query over the given tables.

Doubles are rounded, since sums depend on the order of the rows, and window times
lose their zone, to compare with SQL on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import (
    event_time,
    hour_bucket,
    pct,
    ratio,
    seconds,
    to_number,
    zero_if_missing,
)
from tracemill.operators import aggregate as agg
from tracemill.operators import pairs as pr
from tracemill.operators.clean import (
    events_in,
    events_of,
    fill_missing,
    positive,
    project,
    require_fields,
    require_nonempty,
    valid_time,
    within_trace,
)
from tracemill.operators.join import join_counts, join_request_usage, scalar_row
from tracemill.operators.order import first_n, sorted_by
from tracemill.operators.sequence import above_mean, adjacent_pairs
from tracemill.plans import analyses as an
from tracemill.registry.feeds import feed_queries
from tracemill.session import shared_folder
from tracemill.sources.adapters import Trace
from tracemill.sources.catalog import SCHEDULE, SUBMIT, TASK_TOPIC, table_schema
from tracemill.sources.replay import event_replay, replay_order, union_events, write_replay
from tracemill.sources.tables import POSITION, read_table, write_table
from tracemill.sources.topics import (
    decode_events,
    encode_events,
    event_schema,
    read_topic,
    route_events,
)
from tracemill.streaming import jobs, sinks
from tracemill.streaming import windows as win

Query = Callable[[SparkSession, str], DataFrame]
TIE = ["event_id"]
DIGITS = 9
LONG_MAX = 2**63 - 1
# Parts that are scanned for their places: events in each, and least number. A window holds a part, with its file's name a row.
PLACE_ROWS, PLACE_PARTS = 250_000, 8
PROPS = T.StructType([T.StructField("k", T.LongType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS, wide: Sequence[str] = (), **columns: int) -> DataFrame:
    """Doubles rounded, decimals as long but for ``wide`` ones, timestamps without a zone."""

    def shown(name: str, dtype: str) -> Column:
        if name in wide:
            return F.col(name)
        if dtype == "double":
            return F.round(name, columns.get(name, digits)).alias(name)
        if dtype.startswith("decimal"):
            return F.col(name).cast("long").alias(name)
        if dtype == "timestamp":
            return F.col(name).cast("timestamp_ntz").alias(name)
        return F.col(name)

    return df.select(*[shown(n, t) for n, t in df.dtypes])


def _trace(make: Callable[[Trace], DataFrame], **digits: int) -> Query:
    return lambda spark, folder: rounded(make(Trace(spark, folder)), **digits)


def _table(name: str, make: Callable[[DataFrame], DataFrame], **digits: int) -> Query:
    return lambda spark, folder: rounded(make(table(spark, folder, name)), **digits)


def _scan(name: str) -> Query:
    """A trace table written as gzip CSV parts and scanned back."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = shared_folder(spark, name)
        write_table(getattr(Trace(spark, folder), name), name, path)
        return rounded(read_table(spark, name, path, glob="*.csv.gz"))

    return run


def _scan_places(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written in order of their job and time: places told apart, and neighbours out of order."""
    path = shared_folder(spark, "scan-places")
    order = ["job_id", "time"]
    events = Trace(spark, folder).job_events
    parts = max(PLACE_PARTS, -(-events.count() // PLACE_ROWS))
    write_table(events.repartitionByRange(parts, *order, *TIE).sortWithinPartitions(*order), "job_events", path)
    scanned = read_table(spark, "job_events", path, glob="*.csv.gz", position=True)
    # Of rows at one place in a file, one after the other in this order, the first is counted.
    in_file = Window.partitionBy("source_file").orderBy(*POSITION)
    place = F.struct(*[c for c in POSITION if c != "source_file"])
    seen = scanned.withColumn("before", F.lag(F.struct(*order)).over(in_file)).withColumn("same", F.lag(place).over(in_file) == place)
    return seen.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce("same", F.lit(False))).alias("places"),
        F.count_if(F.col("before") > F.struct(*order)).alias("out_of_order"),
    )


def _text_of(df: DataFrame, blank: Column) -> DataFrame:
    """Every field as text, blank where ``blank`` holds."""
    return df.select(
        *[
            F.when(blank, F.lit(" ")).otherwise(F.col(c).cast("string")).alias(c) if c != "event_id" else F.col(c)
            for c in df.columns
        ]
    )


def _fill(t: Trace) -> DataFrame:
    return fill_missing(_text_of(t.job_events, F.col("event_id") % 7 == 0), table_schema("job_events"))


def _fields(t: Trace) -> DataFrame:
    """The scalar functions side by side."""
    text = F.when(F.col("event_id") % 11 == 0, F.lit("x")).otherwise(
        F.concat(F.lit(" "), F.col("machine_id").cast("string"), F.lit(" "))
    )
    rows = within_trace(valid_time(project(t.task_events, ["event_id", "time", "machine_id", "cpu_request", "memory_request"])))
    return rows.select(
        "event_id",
        seconds("time").alias("seconds"),
        hour_bucket("time").alias("hour"),
        event_time("time").alias("event_time"),
        to_number(text, "bigint").alias("machine"),
        zero_if_missing(text).alias("machine_or_zero"),
        ratio("cpu_request", "memory_request").alias("ratio"),
        pct("cpu_request", F.lit(2.0)).alias("pct"),
    )


def _decoded(feed: DataFrame, keep: list[str]) -> DataFrame:
    """Routed records with every field of their values; a job's record has no task fields."""
    fields = {f.name: f for name in ("task_events", "job_events") for f in event_schema(name)}
    schema = T.StructType([fields[n] for n in fields])
    return feed.withColumn("e", F.from_json("value", schema)).select(
        "topic", "partition", "key", *keep, *[f"e.{n}" for n in fields if n not in keep]
    )


def _routed(t: Trace) -> DataFrame:
    jobs_, tasks = (
        fill_missing(df, table_schema(name))
        for name, df in (("job_events", t.job_events), ("task_events", t.task_events))
    )
    union = union_events(jobs_, tasks).drop("topic_rank")
    return _decoded(route_events(union, keep=["event_id"]), ["event_id"])


def _replayed(t: Trace) -> DataFrame:
    return _decoded(event_replay(t.job_events, t.task_events, TIE), ["time"])


def _replay_order_check(t: Trace) -> DataFrame:
    """Rows of the replay order, neighbours out of order within a task, and tasks that overlap."""
    order = ["time", "topic_rank", "event_id"]
    ordered = replay_order(t.job_events, t.task_events, TIE).select(
        *order, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("nth")
    )
    before = F.lag(F.struct(*order)).over(Window.partitionBy("task").orderBy("nth"))
    tasks = ordered.withColumn("before", before).groupBy("task").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("before") > F.struct(*order)).alias("out_of_order"),
        F.min(F.struct(*order)).alias("first"),
        F.max(F.struct(*order)).alias("last"),
    )
    overlaps = F.col("first") < F.lag("last").over(Window.orderBy("task"))  # a row a task
    return tasks.withColumn("overlaps", overlaps).agg(
        F.sum("rows").alias("rows"), F.sum("out_of_order").alias("out_of_order"),
        F.count_if("overlaps").alias("overlaps"),
    )


def _few_jobs(t: Trace) -> DataFrame:
    """All events as those of three jobs."""
    return t.job_events.withColumn("job_id", F.regexp_extract("user", r"(\d+)$", 1).cast("long") % 3)


def _metrics(t: Trace) -> DataFrame:
    return sinks.to_metrics(win.machine_totals(win.with_event_time(t.task_events)))


def _pairs(t: Trace, start: int, end: int) -> DataFrame:
    return pr.pair_events(t.job_events, start, end)


def _pair_totals(events: Callable[[Trace], DataFrame]) -> Query:
    """Totals per job. The total over all pairs of a hot job passes 64 bits: a column in which one does stays a decimal."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        totals = pr.pair_totals(pr.pair_events(events(Trace(spark, folder)), SUBMIT, SCHEDULE)).select(
            F.col("key").alias("job_id"), "pairs", "total", "shortest", "longest"
        )
        most = totals.agg(*[F.max(F.abs(c)).alias(c) for c in ("pairs", "total")]).first()
        wide = [c for c in most.asDict() if (most[c] or 0) > LONG_MAX]
        return rounded(totals, wide=wide)

    return run


# Ranges of time in a staged topic: records in each, which a task sorts, and least number; and the batches that take them.
FILE_ROWS, FILES, FILE_BATCHES = 500_000, 12, 6
_STAGED: dict[tuple[str, str], tuple[str, int]] = {}


def _staged(spark: SparkSession, folder: str) -> tuple[str, int]:
    known = (spark.sparkContext.applicationId, folder)
    if known not in _STAGED:
        t = Trace(spark, folder)
        path = shared_folder(spark, "topics")
        files = max(FILES, -(-2 * t.events.count() // FILE_ROWS))  # a job and a task record an event
        write_replay(t.job_events, t.task_events, TIE, files=files, path=path)
        _STAGED[known] = path, files
    return _STAGED[known]


def staged_topic(spark: SparkSession, folder: str) -> str:
    """The replay feed written as topics in the shared folder, once for a session and folder."""
    return _staged(spark, folder)[0]


def bounded_batches(spark: SparkSession, folder: str) -> dict[str, str]:
    """Options to read the staged topic in a few batches."""
    path, files = _staged(spark, folder)
    return {"fmt": "text", "path": path, "maxFilesPerTrigger": str(-(-files // FILE_BATCHES))}


def _streamed(stream: Callable[..., DataFrame], keys: list[str], **options: str | None) -> Query:
    """A streaming job run over the whole topic in bounded batches, and the last update of each window."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        windows = stream(spark, **bounded_batches(spark, folder), **options)
        out = shared_folder(spark, "updates")
        query = sinks.start(sinks.batch_sink(windows, out), shared_folder(spark, "checkpoint"), available_now=True, uncounted=spark)
        sinks.run_streams(spark, [query])
        return rounded(sinks.latest_updates(spark.read.parquet(out), ["window_start", "window_end", *keys]))

    return run


def _metrics_stream(spark: SparkSession, folder: str) -> DataFrame:
    windows = jobs.machine_metrics_stream(spark, **bounded_batches(spark, folder))
    out = shared_folder(spark, "metrics")
    query = sinks.start(sinks.metrics_sink(windows, out), shared_folder(spark, "checkpoint"), available_now=True)
    sinks.run_streams(spark, [query])
    return rounded(sinks.newest_gauges(spark.read.parquet(out)))


def _read_topic(spark: SparkSession, folder: str) -> DataFrame:
    """The decoded task topic, appended to a table by a stream."""
    events = decode_events(
        read_topic(spark, TASK_TOPIC, **bounded_batches(spark, folder)), event_schema("task_events")
    )
    out = shared_folder(spark, "decoded")
    writer = events.writeStream.format("parquet").option("path", out)
    sinks.run_streams(spark, [sinks.start(writer, shared_folder(spark, "checkpoint"), available_now=True)])
    return rounded(spark.read.schema(event_schema("task_events")).parquet(out))


def all_queries() -> dict[str, Query]:
    return table_queries() | feed_queries(bounded_batches, rounded)


def table_queries() -> dict[str, Query]:
    return {
        # Sources and sinks
        "scan_job_events": _scan("job_events"),
        "scan_task_events": _scan("task_events"),
        "scan_machine_events": _scan("machine_events"),
        "scan_task_usage": _scan("task_usage"),
        "scan_machine_attributes": _scan("machine_attributes"),
        "scan_task_constraints": _scan("task_constraints"),
        "scan_places": _scan_places,
        "decode_json_props": _table(
            "events", lambda df: decode_events(df, PROPS, value="props")
        ),
        "encode_events": _trace(lambda t: encode_events(t.job_events, keep=["event_id"])),
        "route_events": _trace(_routed),
        "read_topic": _read_topic,
        "metric_range": _trace(lambda t: sinks.metric_range(_metrics(t), "total_cpu_usage")),
        # Cleaning, projection, predicates, scalar functions
        "require_nonempty": _trace(
            lambda t: require_nonempty(t.job_events, ["scheduling_class", "user"]).select(
                "event_id", "scheduling_class", "user"
            )
        ),
        "require_fields": _trace(
            lambda t: require_fields(t.task_events, ["job_id", "machine_id"]).select(
                "event_id", "job_id", "machine_id"
            )
        ),
        "events_of": _trace(lambda t: events_of(t.task_events, 2).select("event_id", "time", "machine_id")),
        "events_in": _trace(lambda t: events_in(t.job_events, [0, 1]).select("event_id", "time", "event_type")),
        "positive": _table(
            "lineitem",
            lambda df: positive(df, ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "l_discount", "l_tax"),
        ),
        "fill_missing": _trace(_fill),
        "event_time": _trace(lambda t: win.with_event_time(t.job_events).select("event_id", "event_time")),
        "scalar_functions": _trace(_fields, seconds=6, ratio=12),
        # Joins
        "eviction_by_machine_join": _trace(lambda t: an.eviction_by_machine(t.task_events, t.task_usage)),
        "join_counts_left": _trace(
            lambda t: join_counts(
                an.peak_usage(t.task_usage), an.machine_evictions(t.task_events), "machine_id", "left"
            )
        ),
        "request_usage_join": _trace(
            lambda t: join_request_usage(t.task_events, t.task_usage)
        ),
        "event_pairs": _trace(
            lambda t: pr.event_pairs(_pairs(t, SUBMIT, SCHEDULE)).select(
                F.col("key").alias("job_id"), seconds("elapsed").alias("elapsed_seconds")
            )
        ),
        "pair_totals_hot": _pair_totals(_few_jobs),
        "event_pair_totals": _pair_totals(lambda t: t.job_events),
        "scalar_row": lambda spark, folder: rounded(
            scalar_row(
                table(spark, folder, "orders").agg(F.count("*").alias("orders")),
                table(spark, folder, "lineitem").agg(F.max("l_quantity").alias("max_quantity")),
            )
        ),
        # Aggregations
        "distribution": _table("lineitem", lambda df: agg.distribution(df, ["l_returnflag", "l_linestatus"])),
        "distribution_distinct": _table(
            "lineitem", lambda df: agg.distribution(df, "l_returnflag", distinct="l_orderkey")
        ),
        "count_if_by": _table(
            "lineitem", lambda df: agg.count_if_by(df, "l_suppkey", F.col("l_returnflag") == "R")
        ),
        "distinct_per_key": _table("lineitem", lambda df: agg.distinct_per_key(df, "l_orderkey", "l_suppkey")),
        "split_counts": _table(
            "lineitem",
            lambda df: agg.split_counts(agg.one_or_several(df, "l_orderkey", "l_suppkey"), "values"),
        ),
        "usage_per_instant": _trace(lambda t: an.usage_per_instant(t.task_usage)),
        "peak_usage": _trace(lambda t: an.peak_usage(t.task_usage)),
        "mean_by": _table("orders", lambda df: agg.mean_by(df, "o_orderpriority", "o_totalprice"), mean=6),
        "summary": _table("lineitem", lambda df: agg.summary(df, "l_quantity"), sum=2),
        "pearson": _table("lineitem", lambda df: agg.pearson(df, "l_quantity", "l_extendedprice")),
        "histogram": _table("lineitem", lambda df: agg.histogram(df, "l_extendedprice")),
        # Events in order
        "adjacent_pairs": _trace(
            lambda t: adjacent_pairs(t.machine_events, "machine_id", 1, 0, tie=TIE, carry=["cpus"])
        ),
        "adjacent_pairs_hot": _trace(
            lambda t: adjacent_pairs(
                t.machine_events.withColumn("all", F.lit(1)), "all", 1, 0, tie=["platform_id", *TIE], carry=["machine_id", "cpus"]
            )
        ),
        "above_mean": _table("events", lambda df: above_mean(df, "value").select("event_id", "value")),
        "top_outliers": _table(
            "events",
            lambda df: first_n(
                above_mean(df, "value").select("event_id", "value"), [F.desc("value"), "event_id"]
            ),
        ),
        "sorted_by": _table(
            "customer", lambda df: sorted_by(agg.distribution(df, "c_nationkey"), "c_nationkey")
        ),
        # Merged feed
        "union_events": _trace(lambda t: union_events(t.job_events, t.task_events)),
        "replay_order": _trace(lambda t: replay_order(t.job_events, t.task_events, TIE)),
        "replay_order_check": _trace(_replay_order_check),
        "event_replay": _trace(_replayed),
        # Windows
        "hopping_usage": _trace(lambda t: win.machine_usage(win.with_event_time(t.task_events))),
        "tumbling_usage": _trace(lambda t: win.machine_totals(win.with_event_time(t.task_events))),
        "hopping_event_counts": _trace(lambda t: win.event_counts(win.with_event_time(t.job_events))),
        # The same windows as streams over the replayed topics
        "resource_usage_stream": _streamed(jobs.resource_usage_stream, ["machine_id"]),
        "event_counts_stream": _streamed(jobs.event_counts_stream, ["user", "event_type"]),
        "event_counts_stream_no_watermark": _streamed(jobs.event_counts_stream, ["user", "event_type"], lateness=None),
        "machine_metrics_stream": _metrics_stream,
        # Analyses
        "machines_by_cpu": _trace(lambda t: an.machines_by_cpu(t.machine_events)),
        "machines_by_cpu_distinct": _trace(lambda t: an.machines_by_cpu(t.machine_events, distinct=True)),
        "jobs_by_class": _trace(lambda t: an.jobs_by_class(t.job_events)),
        "jobs_by_class_distinct": _trace(lambda t: an.jobs_by_class(t.job_events, distinct=True)),
        "tasks_by_class": _trace(lambda t: an.tasks_by_class(t.task_events)),
        "tasks_by_class_distinct": _trace(lambda t: an.tasks_by_class(t.task_events, distinct=True)),
        "eviction_probability": _trace(lambda t: an.eviction_probability(t.task_events)),
        "eviction_probability_keep_zero": _trace(
            lambda t: an.eviction_probability(t.task_events, keep_zero=True)
        ),
        "job_locality": _trace(lambda t: an.job_locality(t.task_events)),
        "request_vs_usage": _trace(lambda t: an.request_vs_usage(t.task_events, t.task_usage)),
        "request_vs_usage_first_only": _trace(
            lambda t: an.request_vs_usage(t.task_events, t.task_usage, first_only=True)
        ),
        "peaks_vs_evictions": _trace(lambda t: an.peaks_vs_evictions(t.task_events, t.task_usage)),
        "peaks_vs_evictions_keep_zero": _trace(
            lambda t: an.peaks_vs_evictions(t.task_events, t.task_usage, keep_zero=True)
        ),
        "power_lost": _trace(lambda t: an.power_lost(t.machine_events, tie=TIE)),
        "scheduling_latency": _trace(lambda t: an.scheduling_latency(t.job_events)),
        "scheduling_latency_first_only": _trace(
            lambda t: an.scheduling_latency(t.job_events, first_only=True)
        ),
        "slow_scheduled_jobs": _trace(lambda t: an.slow_scheduled_jobs(t.job_events)),
        "latency_by_hour": _trace(lambda t: an.latency_by_hour(t.job_events, tie=TIE)),
        "latency_by_hour_per_job": _trace(
            lambda t: an.latency_by_hour(t.job_events, tie=TIE, per_job=True)
        ),
        "job_durations": _trace(lambda t: an.job_durations(t.job_events)),
        "duration_histogram": _trace(lambda t: an.duration_histogram(t.job_events), bin_start=7, bin_end=7),
        "duration_histogram_hot": _trace(lambda t: an.duration_histogram(_few_jobs(t)), bin_start=7, bin_end=7),
        "long_jobs": _trace(lambda t: an.long_jobs(t.job_events)),
    }
