"""Streaming windows, sinks and jobs over folders of JSON lines."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.registry import queries
from tracemill.registry.queries import staged_topic
from tracemill.session import shared_folder
from tracemill.sources.adapters import Trace
from tracemill.sources.catalog import TASK_TOPIC
from tracemill.sources.topics import read_topic
from tracemill.streaming import jobs, sinks
from tracemill.streaming.windows import event_counts, hopping, machine_totals, machine_usage, with_event_time

MINUTE = 60_000_000
KEYS = ["window_start", "window_end", "machine_id"]


def put(root, topic, batches):
    """One file per batch, in order of modification time."""
    folder = root / f"topic={topic}" / "partition=0"
    folder.mkdir(parents=True)
    for i, events in enumerate(batches):
        file = folder / f"{i:03d}.txt"
        file.write_text("".join(json.dumps(e) + "\n" for e in events))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(root)


def task(minute, machine, cpu):
    return {"time": minute * MINUTE, "job_id": 6439592366, "machine_id": machine, "cpu_request": cpu, "memory_request": cpu}


FIRST = [task(10, 1, 0.5), task(11, 1, 0.25)]
NEWER = [task(30, 2, 1.0)]
NEWEST = [task(31, 2, 1.0)]
LATE = [task(12, 1, 9.0), task(27, 1, 1.0)]


def run(writer, root, name):
    query = sinks.start(writer, f"{root}/checkpoint-{name}", available_now=True)
    query.awaitTermination()
    return query


def usage(spark, root, name="u", **options):
    windows = jobs.resource_usage_stream(spark, fmt="text", path=root, maxFilesPerTrigger="1", **options)
    out = f"{root}/{name}"
    query = run(sinks.batch_sink(windows, out), root, name)
    return sinks.latest_updates(spark.read.parquet(out), KEYS), query


def totals(df):
    return {(r.window_start.minute, r.machine_id): r.total_cpu_usage for r in df.collect()}


def test_windows_of_a_stream(spark, tmp_path):
    got, _ = usage(spark, put(tmp_path / "t", TASK_TOPIC, [FIRST, NEWER]))
    want = {(m, 1): 0.75 for m in range(7, 11)} | {(6, 1): 0.5, (11, 1): 0.25}
    assert totals(got) == want | {(m, 2): 1.0 for m in range(26, 31)}


def test_late_events(spark, tmp_path):
    # The watermark moves after a batch, so the batch right after it is not yet cut.
    got, _ = usage(spark, put(tmp_path / "a", TASK_TOPIC, [FIRST, NEWER, LATE]))
    assert totals(got)[(12, 1)] == 9.0
    got, query = usage(spark, put(tmp_path / "b", TASK_TOPIC, [FIRST, NEWER, NEWEST, LATE]))
    found = totals(got)
    assert (12, 1) not in found and found[(27, 1)] == 1.0
    dropped = [s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]]
    assert sum(dropped) == 5


def test_no_watermark_keeps_late_events(spark, tmp_path):
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST, NEWER, NEWEST, LATE])
    got, _ = usage(spark, root, lateness=None)
    assert totals(got)[(12, 1)] == 9.0


def test_stream_equals_static_table(spark, tmp_path):
    events = [task(m, m % 3, m / 8) for m in range(1, 41)]
    root = put(tmp_path / "t", TASK_TOPIC, [events[i : i + 10] for i in range(0, 40, 10)])
    got, _ = usage(spark, root)
    static = spark.createDataFrame(events)
    want = machine_usage(with_event_time(static))
    columns = [*KEYS, "total_cpu_usage", "avg_memory_request_per_task"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_event_counts_of_a_static_table(spark):
    df = with_event_time(spark.createDataFrame([(0, "u", 1), (MINUTE, "u", 1), (0, "v", 2)], "time long, user string, event_type long"))
    got = event_counts(df).filter("window_start = timestamp'1970-01-01 00:00:00'")
    assert sorted((r.user, r.event_type, r.event_count) for r in got.collect()) == [("u", 1, 2), ("v", 2, 1)]


def test_metrics_sink(spark, tmp_path):
    nothing = {"time": 13 * MINUTE, "job_id": 1, "machine_id": 1}
    root = put(tmp_path / "t", TASK_TOPIC, [[*FIRST, nothing], NEWER])
    windows = jobs.machine_metrics_stream(spark, fmt="text", path=root, maxFilesPerTrigger="1")
    pushed = []
    run(sinks.metrics_sink(windows, f"{root}/m", push=lambda df, i: pushed.append((i, df.count()))), root, "m")
    metrics = spark.read.parquet(f"{root}/m")
    got = {(r.batch_id, r.metric, r.machine_id): (r.value, r.window_end.minute) for r in metrics.collect()}
    # The newest window with a value wins within a batch; a window without one is skipped.
    assert got[(0, "total_cpu_usage", "1")] == (0.25, 12)
    assert got[(1, "total_memory_usage", "2")] == (1.0, 31)
    assert len(got) == 4 and pushed[0] == (0, 2)
    recent = sinks.metric_range(metrics, "total_cpu_usage").collect()
    assert [(r.machine_id, r.value) for r in recent] == [("2", 1.0)]
    assert sinks.metric_range(metrics, "total_cpu_usage", minutes=30).count() == 2
    assert sinks.metric_range(metrics, "total_cpu_usage", job="other").count() == 0


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST])
    usage(spark, root)
    folder = tmp_path / "t" / f"topic={TASK_TOPIC}" / "partition=0"
    (folder / "001.txt").write_text(json.dumps(task(11, 1, 4.0)) + "\n")
    got, _ = usage(spark, root)
    assert totals(got)[(8, 1)] == 4.75


MARKERS = [task(0, 1, 5.0) | {"time": 0}, task(0, 1, 5.0) | {"time": 2**63 - 1}]


def test_marker_times(spark, tmp_path):
    """Times before and after the trace are no windows and move no watermark."""
    batches = [[*FIRST, *MARKERS], [task(12, 1, 1.0)], [task(13, 1, 1.0)]]
    got, query = usage(spark, put(tmp_path / "t", TASK_TOPIC, batches))
    assert totals(got)[(12, 1)] == 2.0 and totals(got)[(9, 1)] == 2.75
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 0
    static = with_event_time(spark.createDataFrame([*FIRST, *MARKERS]), trace_only=True)
    assert machine_totals(static).count() == 2 and machine_usage(static).count() == 6
    metrics = jobs.machine_metrics_stream(spark, fmt="text", path=str(tmp_path / "t"), maxFilesPerTrigger="1")
    run(sinks.metrics_sink(metrics, f"{tmp_path}/m"), tmp_path, "m")
    assert spark.read.parquet(f"{tmp_path}/m").agg({"window_end": "max"}).first()[0].minute == 14


def test_bounded_batches_lose_nothing(spark):
    """The staged topic has many files, and no batch is behind the watermark."""
    folder = "/root/testdata/sf0.001"
    path = staged_topic(spark, folder)
    windows = jobs.resource_usage_stream(spark, fmt="text", path=path, maxFilesPerTrigger="1")
    out = shared_folder(spark, "updates")
    query = sinks.start(sinks.batch_sink(windows, out), shared_folder(spark, "checkpoint"), available_now=True)
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) >= 5
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 0
    got = sinks.latest_updates(spark.read.parquet(out), KEYS)
    want = machine_usage(with_event_time(Trace(spark, folder).task_events.fillna(0, ["machine_id"])))
    assert got.count() == want.count()


@pytest.mark.parametrize("duration", ["5 minutes", "interval 5 minutes", "INTERVAL 300 seconds"])
def test_durations_as_spark_takes_them(spark, duration):
    df = with_event_time(spark.createDataFrame([(0, 1), (MINUTE, 1)], "time long, machine_id long"))
    got = hopping(df, ["machine_id"], {"n": ("count", "*")}, duration=duration, slide="1 minute")
    assert got.count() == 6 and got.agg({"n": "max"}).first()[0] == 2
    odd = hopping(df, ["machine_id"], {"n": ("count", "*")}, duration="5 minutes", slide="2 minutes")
    assert odd.agg({"n": "sum"}).first()[0] >= 4


def test_metric_range_reads_the_newest_hours(spark, tmp_path):
    batches = [[task(m, 1, m / 8)] for m in (10, 70, 130, 190, 191)]
    windows = jobs.machine_metrics_stream(spark, fmt="text", path=put(tmp_path / "t", TASK_TOPIC, batches), maxFilesPerTrigger="1")
    run(sinks.metrics_sink(windows, f"{tmp_path}/m"), tmp_path, "m")
    series = spark.read.parquet(f"{tmp_path}/m")
    recent = sinks.metric_range(series, "total_cpu_usage")
    assert [r.value for r in recent.orderBy("window_end").collect()] == [190 / 8, 191 / 8]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert sum(sinks.HOUR in line for line in plan.splitlines() if "PushedFilters" in line) >= 2
    sinks.compact_metrics(spark, f"{tmp_path}/m", f"{tmp_path}/compact")
    again = sinks.metric_range(spark.read.parquet(f"{tmp_path}/compact"), "total_cpu_usage")
    assert again.count() == 2
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert sum(sinks.HOUR in line for line in plan.splitlines() if "PartitionFilters" in line) >= 2


def test_few_metric_files(spark, tmp_path):
    """A task that has rows writes one file for each metric, however many hours a batch spans."""
    batches = [[task(60 * h + k, h % 7, 1.0) for h in range(200)] for k in range(2)]
    windows = jobs.machine_metrics_stream(spark, fmt="text", path=put(tmp_path / "t", TASK_TOPIC, batches), maxFilesPerTrigger="1", lateness=None)
    run(sinks.metrics_sink(windows, f"{tmp_path}/m"), tmp_path, "m")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for batch in (0, 1):
        for metric in sinks.METRICS:
            assert 0 < len(list((tmp_path / "m" / f"batch_id={batch}" / f"metric={metric}").glob("part-*"))) <= tasks


def test_push_evaluates_a_batch_once(spark, tmp_path):
    """What is pushed is what was written."""
    pushed = {}
    windows = jobs.machine_metrics_stream(spark, fmt="text", path=put(tmp_path / "t", TASK_TOPIC, [FIRST]))
    writer = sinks.metrics_sink(windows, f"{tmp_path}/m", push=lambda df, i: pushed.update({i: (sorted(map(tuple, df.collect())), df.inputFiles())}))
    run(writer, tmp_path, "m")
    rows, files = pushed[0]
    assert files and all("/m/batch_id=0/" in f for f in files)
    assert rows == sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/m").select("job", "metric", "machine_id", "value", "window_end").collect())


def test_finite_streams_all_finish(spark, tmp_path):
    """The first to end does not cut the others short; a failing one does, and is raised."""
    small = put(tmp_path / "a", TASK_TOPIC, [FIRST])
    large = put(tmp_path / "b", TASK_TOPIC, [[task(m, 1, 1.0)] for m in range(10, 16)])
    outs = []
    for i, root in enumerate((small, large)):
        windows = jobs.resource_usage_stream(spark, fmt="text", path=root, maxFilesPerTrigger="1")
        outs.append(sinks.start(sinks.batch_sink(windows, f"{root}/out"), f"{root}/c", available_now=True))
    sinks.run_streams(spark, outs)
    got = sinks.latest_updates(spark.read.parquet(f"{large}/out"), KEYS)
    assert totals(got)[(11, 1)] == 5.0 and not any(q.isActive for q in outs)

    def fail(df, i):
        raise ValueError("no gateway")

    windows = jobs.machine_metrics_stream(spark, fmt="text", path=small)
    endless = sinks.start(sinks.console_sink(jobs.resource_usage_stream(spark, fmt="text", path=large)), f"{large}/e")
    failing = sinks.start(sinks.metrics_sink(windows, f"{small}/m", push=fail), f"{small}/f")
    with pytest.raises(Exception, match="no gateway"):
        sinks.run_streams(spark, [endless, failing])
    assert not endless.isActive


def test_streams_run_together(spark, tmp_path):
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST])
    put(tmp_path / "t" / "j", "job-events", [[{"time": MINUTE, "job_id": 1, "user": "u", "event_type": 0}]])
    tasks = jobs.resource_usage_stream(spark, fmt="text", path=root)
    counts = jobs.event_counts_stream(spark, fmt="text", path=f"{root}/j")
    queries = [
        sinks.start(sinks.console_sink(df), f"{root}/c{i}") for i, df in enumerate((tasks, counts))
    ]
    for query in queries:
        query.processAllAvailable()
    progress = [query.recentProgress for query in queries]
    sinks.run_streams(spark, queries, timeout=1)
    assert not any(q.isActive for q in queries)
    assert [sum(p["numInputRows"] for p in batches) for batches in progress] == [2, 1]
    assert all("Console" in batches[0]["sink"]["description"] for batches in progress)


def test_kafka_source_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_topic(spark, TASK_TOPIC, servers="broker:9092")


def test_console_takes_few_rows_to_the_driver(spark, tmp_path):
    """The sink gets a few rows of each task and the source is read whole, with the state of all windows."""
    rows = [{"time": MINUTE, "job_id": 1, "user": f"u{i}", "event_type": 0} for i in range(4000)]
    root = put(tmp_path / "t", "job-events", [rows])
    counts = jobs.event_counts_stream(spark, fmt="text", path=root)
    query = sinks.start(sinks.console_sink(counts), f"{root}/c", available_now=True)
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [p["numInputRows"] for p in progress] == [4000]
    assert 0 < progress[0]["sink"]["numOutputRows"] <= (sinks.SHOWN + 1) * parts
    assert progress[0]["stateOperators"][0]["numRowsUpdated"] == 5 * 4000


def test_staged_files_have_so_many_records(spark, monkeypatch):
    """A task that stages a topic sorts so many records, whatever the table has; the batches stay few."""
    monkeypatch.setattr(queries, "FILE_ROWS", 100)
    monkeypatch.setattr(queries, "_STAGED", {})
    options = queries.bounded_batches(spark, "/root/testdata/sf0.001")
    lines = spark.read.text(f"{options['path']}/topic={TASK_TOPIC}").groupBy(F.input_file_name().alias("file")).count()
    counts = [r["count"] for r in lines.collect()]
    assert len(counts) >= 18 and max(counts) < 150 and options["maxFilesPerTrigger"] == "4"


def test_updates_are_not_sorted(spark):
    windows = spark.createDataFrame([(1, 2.0, 3, 0), (1, None, 4, 1)], "k long, a double, n long, batch_id int")
    last = sinks.latest_updates(windows, ["k"])
    assert "Sort" not in last._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in last.collect()] == [(1, None, 4)]


def test_state_without_its_count(spark, tmp_path):
    rows = {}
    for name, uncounted in (("counted", None), ("uncounted", spark)):
        windows = jobs.machine_metrics_stream(spark, fmt="text", path=put(tmp_path / name, TASK_TOPIC, [FIRST]))
        writer, out = sinks.batch_sink(windows, f"{tmp_path}/{name}/o"), f"{tmp_path}/{name}/c"
        query = sinks.start(writer, out, available_now=True, uncounted=uncounted)
        query.awaitTermination()
        rows[name] = query.recentProgress[0]["stateOperators"][0]["numRowsTotal"], spark.read.parquet(f"{tmp_path}/{name}/o").count()
    assert rows["counted"][0] > 0 == rows["uncounted"][0] and rows["counted"][1] == rows["uncounted"][1]
    assert spark.conf.get(sinks.COUNTED) == "true"
