"""Late and broken records, accounts, closed windows, state, merged parts, converted tables, sketches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import aggregate as agg
from tracemill.operators import pairs as pr
from tracemill.operators.clean import account_rows, clean_with_account, fill_missing, require_fields, require_nonempty
from tracemill.plans import analyses as an
from tracemill.registry import feeds, queries
from tracemill.registry.feeds import _delayed_topic
from tracemill.registry.queries import all_queries
from tracemill.session import COUNTED, LOGGED, shared_folder
from tracemill.sources.adapters import Trace
from tracemill.sources.catalog import JOB_TOPIC, TASK_TOPIC, table_schema
from tracemill.sources.replay import merge_parts, part_index
from tracemill.sources.tables import convert_table, read_table
from tracemill.sources.topics import decode_events, decode_or_keep, event_schema, read_topic
from tracemill.streaming import jobs, late, sinks, state
from tracemill.streaming import windows as win
from test_streaming import FIRST, KEYS, LATE, NEWER, NEWEST, put, run, task, totals

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- late rows ---


def late_run(spark, root, checkpoint, out, files="1"):
    topic = read_topic(spark, TASK_TOPIC, fmt="text", path=root, maxFilesPerTrigger=files)
    events = win.with_event_time(decode_events(topic, event_schema("task_events")))
    both = late.windows_and_rows(events, lambda df: win.machine_usage(df, lateness=None))
    query = sinks.start(late.late_sink(both, out, checkpoint), checkpoint, available_now=True)
    query.awaitTermination()
    windows, rows = late.read_late(spark, out, both)
    return sinks.latest_updates(windows, KEYS), rows, query


def test_late_rows_are_kept(spark, tmp_path):
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST, NEWER, NEWEST, LATE])
    windows, rows, query = late_run(spark, root, f"{tmp_path}/c", f"{tmp_path}/o")
    # Before the last file the watermark was 25: all windows of minute 12 are closed, of 27 none.
    assert [(r.time, r.cpu_request, r.lost) for r in rows.collect()] == [(12 * 60_000_000, 9.0, 5)]
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 5
    assert totals(windows)[(27, 1)] == 1.0 and totals(windows)[(10, 1)] == 0.75


def test_late_by_some_windows_and_a_restart(spark, tmp_path):
    """Minute 23 is in windows that end at 24 to 28; the watermark of 26 has closed three. A batch is judged alike after a restart."""
    out, checkpoint = f"{tmp_path}/o", f"{tmp_path}/c"
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST, NEWER, NEWEST])
    late_run(spark, root, checkpoint, out)
    file = tmp_path / "t" / f"topic={TASK_TOPIC}" / "partition=0" / "009.txt"
    file.write_text(json.dumps(task(23, 1, 2.0)) + "\n")
    windows, rows, _ = late_run(spark, root, checkpoint, out)
    assert [(r.cpu_request, r.lost) for r in rows.collect()] == [(2.0, 3)]
    got = totals(windows)
    assert {m for m, k in got if k == 1 and m > 12} == {22, 23}


def test_nothing_late(spark, tmp_path):
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST, NEWER])
    windows, rows, _ = late_run(spark, root, f"{tmp_path}/c", f"{tmp_path}/o")
    assert rows.count() == 0 and windows.count() == 11


def test_registered_late_rows_are_late(spark):
    """The query's topic has rows that lose all windows and rows that lose some."""
    topic = read_topic(spark, JOB_TOPIC, fmt="text", path=_delayed_topic(spark, FOLDER), maxFilesPerTrigger="1")
    events = win.with_event_time(decode_events(topic, event_schema("job_events")))
    both = late.windows_and_rows(events, lambda df: win.event_counts(df, lateness=None))
    out, checkpoint = shared_folder(spark, "late"), shared_folder(spark, "checkpoint")
    query = sinks.start(late.late_sink(both, out, checkpoint), checkpoint, available_now=True)
    query.awaitTermination()
    _, rows = late.read_late(spark, out, both)
    lost = rows.agg(F.sum("lost"), F.count("*")).first()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert lost[1] > 10 and 0 < dropped <= lost[0]  # Spark counts rows after events of one group were added up


# --- closed windows and state ---


def test_closed_windows_write_less_state(spark, tmp_path):
    """The same windows; an event updates the row of its slide, not those of five windows."""
    batches = [[task(10 + m // 4, k, k / 8) for k in range(5)] for m in range(48)] + [[task(60, 1, 1.0)]]
    root = put(tmp_path / "t", TASK_TOPIC, batches)

    def rows_written(stream, mode):
        out = f"{tmp_path}/{mode}"
        df = stream(spark, fmt="text", path=root, maxFilesPerTrigger="2")
        query = run(sinks.batch_sink(df, out, mode), tmp_path, f"c-{mode}")
        written = [s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]]
        return spark.read.parquet(out), sum(written)

    updates, most = rows_written(jobs.resource_usage_stream, "update")
    closed, fewer = rows_written(jobs.closed_usage_stream, "append")
    want = sinks.latest_updates(updates, KEYS).filter("window_end <= timestamp '1970-01-01 00:55:00'")
    shown = lambda df: sorted(tuple(r) for r in df.select(*KEYS, *win.USAGE).collect())
    assert shown(closed) == shown(want) and closed.count() == 16 * 5
    assert fewer < 0.8 * most


def test_slides_that_do_not_fill_a_window(spark):
    df = win.with_event_time(spark.createDataFrame([(0, 1)], "time long, machine_id long"))
    with pytest.raises(ValueError, match="fill"):
        win.chained(df, ["machine_id"], {"n": ("count", "*")}, duration="5 minutes", slide="2 minutes")


def test_state_can_be_read(spark, tmp_path):
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST, NEWER, NEWEST])
    query = run(sinks.batch_sink(jobs.resource_usage_stream(spark, fmt="text", path=root, maxFilesPerTrigger="1"), f"{tmp_path}/o"), tmp_path, "c")
    checkpoint = f"{tmp_path}/checkpoint-c"
    assert [r.partitions for r in state.state_operators(spark, checkpoint).collect()] == [8]
    ends = {r.window_end.minute: r.groups for r in state.open_windows(spark, checkpoint).collect()}
    assert ends == {m: 1 for m in range(31, 37)}  # what minutes 30 and 31 opened; the watermark is 26
    [row] = state.state_sizes(spark, query).collect()
    assert row.rows == 6 and row.bytes > 0 and row.dropped == 0


def test_read_state_is_in_files(spark, tmp_path, monkeypatch):
    """The state of the registered query needs no log of changes to be made again, and is the same as with one."""
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST, NEWER, NEWEST])
    held = {}
    for name, snapshots in (("log", None), ("files", spark)):
        windows = jobs.resource_usage_stream(spark, fmt="text", path=root, maxFilesPerTrigger="1")
        writer, checkpoint = sinks.batch_sink(windows, f"{tmp_path}/{name}"), f"{tmp_path}/c-{name}"
        sinks.start(writer, checkpoint, available_now=True, uncounted=spark, snapshots=snapshots).awaitTermination()
        logs = list((tmp_path / f"c-{name}").rglob("*.changelog"))
        assert bool(logs) == (snapshots is None)
        held[name] = sorted(map(tuple, state.open_windows(spark, checkpoint).collect()))
    assert held["files"] == held["log"] and len(held["log"]) == 6
    checkpoints = []
    monkeypatch.setattr(feeds, "shared_folder", lambda s, purpose: checkpoints.append(str(tmp_path / f"{len(checkpoints)}-{purpose}")) or checkpoints[-1])
    assert all_queries()["open_windows"](spark, FOLDER).count() == 2
    saved = [list(tmp_path.glob(f"*-checkpoint/state/**/*.{kind}")) for kind in ("changelog", "zip")]
    assert saved[0] == [] and saved[1] and spark.conf.get(LOGGED) == "true"


def test_state_is_read_without_a_count(spark, tmp_path):
    """Started with a log and restarted with files, and read either way; the settings are as before."""
    root = put(tmp_path / "t", TASK_TOPIC, [FIRST, NEWER])
    for more, snapshots in ((None, None), (NEWEST, spark)):
        if more:
            file = tmp_path / "t" / f"topic={TASK_TOPIC}" / "partition=0" / "009.txt"
            file.write_text("".join(json.dumps(e) + "\n" for e in more))
        windows = jobs.resource_usage_stream(spark, fmt="text", path=root, maxFilesPerTrigger="1")
        writer = sinks.batch_sink(windows, f"{tmp_path}/o")
        sinks.start(writer, f"{tmp_path}/c", available_now=True, snapshots=snapshots).awaitTermination()
    seen = []
    load = type(spark.read).load
    reader = type(spark.read)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(reader, "load", lambda self, *a, **b: seen.append(spark.conf.get(COUNTED)) or load(self, *a, **b))
        ends = {r.window_end.minute: r.groups for r in state.open_windows(spark, f"{tmp_path}/c").collect()}
    assert ends == {m: 1 for m in range(31, 37)} and seen == ["false"]
    assert spark.conf.get(COUNTED) == "true" and spark.conf.get(LOGGED) == "true"


# --- broken records ---


def test_what_is_broken(spark):
    schema = event_schema("job_events", ["time", "job_id", "user"])
    good = ['{"time": 5, "job_id": 6439592366, "user": "u"}', "{}", '{"user": null}', '{"time": 1, "other": [1, 2]}']
    bad = ['{"time": 5, "job_id"', "no", '{"time": "soon"}', '{"job_id": 1.5}', "", "  ", "[1, 2]", '"text"', "7"]
    rows = spark.createDataFrame([(v,) for v in [*good, *bad, None]], "value string")
    found = decode_or_keep(rows, schema).collect()
    assert [r.broken for r in found] == [False] * len(good) + [True] * (len(bad) + 1)
    assert [r.raw for r in found] == [None] * len(good) + bad + [None]
    assert all(r[f] is None for r in found if r.broken for f in ("time", "job_id", "user"))
    assert found[0][:3] == (5, 6439592366, "u") and found[3][:3] == (1, None, None)


def test_a_field_named_like_the_corrupt_one(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("_corrupt", T.LongType())])
    rows = spark.createDataFrame([('{"_corrupt": 3}',), ("x",)], "value string")
    assert [(r["_corrupt"], r.broken) for r in decode_or_keep(rows, schema).collect()] == [(3, False), (None, True)]


# --- accounts ---


def test_account_matches_the_rules(spark):
    rows = [("5", "1", "0", "u", " 2 "), ("x", "1", "0", "u", "3"), (" ", "2", "0", "u", "3"), ("7", None, "0", "u", ""),
            ("8", "3", "1", " ", "1"), ("9", "4", "1", None, "1"), ("10", "5", "1", "v", "two"), ("11", "6", "1", "v", None)]
    df = spark.createDataFrame(rows, "time string, job_id string, event_type string, user string, scheduling_class string")
    schema = table_schema("job_events")
    cleaned, account = clean_with_account(df, schema, ["time", "job_id"], ["user"])
    got = cleaned.collect()
    told = {(r.action, r.rule, r.field): r.rows for r in account_rows(spark, account).collect()}
    assert told["read", "all", ""] == 8 and told["dropped", "nonempty", "user"] == 2
    assert told["dropped", "required", "time"] == 2 and told["dropped", "required", "job_id"] == 1
    assert told["nulled", "malformed", "scheduling_class"] == 1 and told["filled", "missing", "scheduling_class"] == 2
    assert told["filled", "missing", "logical_job_name"] == 3 == len(got)
    want = require_nonempty(df.withColumn("user", F.nullif(F.trim("user"), F.lit(""))), ["user"])
    want = want.withColumn("time", F.trim("time").try_cast("long")).withColumn("job_id", F.trim("job_id").try_cast("long"))
    want = fill_missing(require_fields(want, ["time", "job_id"]).withColumn("scheduling_class", F.trim("scheduling_class")), schema)
    assert sorted(got) == sorted(want.collect())


def test_account_in_one_pass(spark):
    """The rows are read once, whatever the number of rules."""
    t = Trace(spark, FOLDER)
    cleaned, account = clean_with_account(t.job_events, table_schema("job_events"), ["time"], ["user"])
    assert plan_of(cleaned).count("FileScan") == 1 and "Exchange" not in plan_of(cleaned)
    cleaned.write.parquet(shared_folder(spark, "cleaned"))
    assert account.get["read|all|"] == t.events.count()


# --- parts in order ---


def test_merge_of_parts(spark, tmp_path):
    """Overlapping parts, equal times across parts, a part within another; no exchange, few parts a span."""
    parts = [[1, 2, 3, 9], [3, 3, 4, 5], [6, 7, 8], [7, 7], [20, 21], []]
    for i, times in enumerate(parts):
        rows = [(t, i, k) for k, t in enumerate(times)]
        spark.createDataFrame(rows, "time long, part long, nth long").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    index = part_index(spark, str(tmp_path / "p"))
    assert {(r.least, r.greatest, r.rows) for r in index.collect()} == {(p[0], p[-1], len(p)) for p in parts if p}
    merged = merge_parts(spark, index, ["time", "part", "nth"])
    want = sorted((t, i, k) for i, times in enumerate(parts) for k, t in enumerate(times))
    assert [tuple(r) for r in merged.collect()] == want
    plan = plan_of(merged)
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time,20)]" in plan
    assert [tuple(r) for r in merge_parts(spark, index, ["time", "part", "nth"], spans=2).collect()] == want
    with pytest.raises(ValueError, match="no part"):
        merge_parts(spark, index.filter("rows < 0"), ["time"])


def test_merged_spans_have_a_task_each(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id as time").repartitionByRange(4, "time").sortWithinPartitions("time").write.parquet(f"{tmp_path}/p")
    merged = merge_parts(spark, part_index(spark, f"{tmp_path}/p"), ["time"])
    seen = merged.select("time", F.spark_partition_id().alias("task")).collect()
    assert [r.time for r in seen] == list(range(100)) and [r.task for r in seen] == sorted(r.task for r in seen)
    assert len({r.task for r in seen}) == 4
    # The query's parts have so many rows, not a share of all.
    monkeypatch.setattr(feeds, "PART_ROWS", 100)
    cut = []
    monkeypatch.setattr(feeds, "merge_parts", lambda s, index, order: cut.append(index.count()) or merge_parts(s, index, order))
    assert tuple(all_queries()["replay_merged_parts"](spark, FOLDER).first()) == (2000, 0, 0) and cut == [20]


def test_scanned_parts_have_so_many_rows(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(queries, "PLACE_ROWS", 50)
    monkeypatch.setattr(queries, "read_table", lambda *a, **b: parts.append(read_table(*a, **b)) or parts[0])
    assert tuple(all_queries()["scan_places"](spark, FOLDER).first()) == (1000, 1000, 0)
    assert max(r["count"] for r in parts[0].groupBy("source_file").count().collect()) < 150


# --- converted tables ---


def test_converted_tables_need_no_exchange(spark, no_broadcast):
    t = Trace(spark, FOLDER)
    tasks, usage, jobs_ = (convert_table(getattr(t, n), n, shared_folder(spark, n), 4) for n in ("task_events", "task_usage", "job_events"))
    pairs = an.job_durations(jobs_)
    joined = tasks.join(usage, ["job_id", "task_index"]).groupBy("job_id", "task_index").count()
    given = t.task_events.join(t.task_usage, ["job_id", "task_index"]).groupBy("job_id", "task_index").count()
    assert "hashpartitioning" not in plan_of(joined) and "hashpartitioning" in plan_of(given)
    assert joined.count() == given.count()
    assert "hashpartitioning(key" not in plan_of(pairs) and "hashpartitioning(job_id" not in plan_of(pairs)
    got, want = (r.first() for r in (an.request_vs_usage(tasks, usage), an.request_vs_usage(t.task_events, t.task_usage)))
    assert got["pairs"] == want["pairs"]
    assert "hashpartitioning(job_id" not in plan_of(an.request_vs_usage(tasks, usage))


# --- sketches ---


def test_sketches_merge(spark):
    rows = spark.range(40_000).select((F.col("id") % 7).alias("hour"), (F.col("id") % 3).alias("class"), (F.col("id") % 9_001).alias("user"))
    stored = agg.distinct_sketches(rows, ["hour", "class"], "user")
    assert stored.count() == 21
    some = agg.distinct_of_sketches(stored.filter("hour < 2")).first()[0]
    exact = rows.filter("hour < 2").select("user").distinct().count()
    assert abs(some - exact) <= 0.03 * exact
    by_class = {r["class"]: r["distinct"] for r in agg.distinct_of_sketches(stored, ["class"]).collect()}
    assert set(by_class) == {0, 1, 2} and all(abs(n - 9_001) <= 270 for n in by_class.values())


# --- pairs of a hot key ---


def test_pairs_of_a_hot_key_spread(spark):
    """One key with very many starts and few ends, beside small keys: every task has a share, the pairs are the same."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(100_000).select(F.lit(1).cast("long").alias("key"), (F.col("id") % 1000).alias("t"), F.lit(True).alias("is_start"))
        ends = spark.createDataFrame([(1, 2000 + k, False) for k in range(8)], hot.schema)
        small = spark.createDataFrame([(k, k, k % 2 == 0) for k in range(2, 60)] + [(4, 9, False)], hot.schema)
        events = hot.unionByName(ends).unionByName(small)
        pairs = pr.every_pair(events, pr.pair_totals(events), share=64)
        assert pairs.filter("key = 4").collect()[0][1:] == (4, 9) and pairs.filter("key > 1").count() == 1
        by_task = [r["count"] for r in pairs.filter("key = 1").groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(by_task) == 800_000 and len(by_task) == 16 and max(by_task) < 3 * 800_000 / 16
        one_instant = events.filter("key = 1").withColumn("t", F.when(F.col("is_start"), 5).otherwise(F.col("t")))
        by_task = pr.every_pair(one_instant, pr.pair_totals(one_instant), share=64).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in by_task) == 800_000 and len(by_task) > 1
        bins = pr.pair_histogram(events, pr.pair_totals(events)).collect()
        assert sum(r["count"] for r in bins) == 800_001
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
