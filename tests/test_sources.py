"""Trace files, cleaning, topics and the replay feed."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from trace_files import job_rows, task_rows, write_part
from tracemill.functions import hour_bucket, pct, ratio, to_number, zero_if_missing
from tracemill.operators.clean import fill_missing, require_fields, require_nonempty, valid_time
from tracemill.sources.adapters import Trace
from tracemill.sources.catalog import TABLES, mandatory_fields, table_schema
from tracemill.sources.replay import event_replay, replay_order, write_replay
from tracemill.sources.tables import POSITION, read_table, write_table
from tracemill.sources.topics import commit_in_order, decode_events, encode_events, event_schema, read_topic, route_events


def test_catalogue():
    assert {name: len(fields) for name, fields in TABLES.items()} == {
        "job_events": 8, "task_events": 13, "machine_events": 6,
        "machine_attributes": 5, "task_constraints": 6, "task_usage": 20,
    }
    assert mandatory_fields("task_events") == ["time", "job_id", "task_index", "event_type", "priority"]
    field = table_schema("machine_attributes")["attribute_deleted"]
    assert field.dataType.typeName() == "boolean" and field.metadata == {"mandatory": True}


def test_scan_of_imperfect_rows(spark, tmp_path):
    lines = [
        [5, "", 6439592366, 0, 7, 1, "u", 2, 9, " 0.5 ", "", "x", 1],
        ['""', "", 1, 0, "", 2, "", "", 0, 0.25, 0.5, 0, 0],
        [7, "", 2],
        [8, "", 3, 0, 1, 1, "u", 0, 0, 0, 0, 0, "", "extra", "extra"],
    ]
    df = read_table(spark, "task_events", write_part(tmp_path / "t", lines))
    assert df.schema.fieldNames() == table_schema("task_events").fieldNames()
    a, b, c, d = df.collect()
    assert (a.job_id, a.cpu_request, a.memory_request, a.disk_space_request) == (6439592366, 0.5, None, None)
    assert a.different_machines_restriction is True and b.different_machines_restriction is False
    assert (b.time, b.machine_id, b.user, b.scheduling_class) == (None, None, None, None)
    assert (c.time, c.job_id, c.task_index, c.cpu_request) == (7, 2, None, None)
    assert d.time == 8 and d.different_machines_restriction is None
    assert require_fields(df, mandatory_fields("task_events")).count() == 2


def test_scan_of_a_folder_of_parts(spark, tmp_path):
    folder = tmp_path / "jobs"
    for part in (2, 0, 1):
        write_part(folder, [[part * 10 + i, "", 1, 0, "u", 0, "", ""] for i in range(5)], part)
    (folder / "notes.txt").write_text("1,2,3\n")
    df = read_table(spark, "job_events", str(folder), glob="*.csv.gz", position=True)
    assert [r.time for r in df.orderBy(*POSITION).collect()] == [p * 10 + i for p in range(3) for i in range(5)]
    again = str(tmp_path / "again")
    write_table(df, "job_events", again)
    back = read_table(spark, "job_events", again)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.drop(*POSITION).collect()))


def test_parquet_copy_of_a_table(spark, tmp_path):
    table = read_table(spark, "task_events", write_part(tmp_path / "t", task_rows()))
    table.write.parquet(str(tmp_path / "copy"))
    copy = read_table(spark, "task_events", str(tmp_path / "copy"), fmt="parquet")
    key = lambda r: (r.time, r.job_id)
    assert sorted(copy.collect(), key=key) == sorted(table.collect(), key=key)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(" 5 ", 0.0), ("x", 2.0), ("", 2.0), (None, 2.0), ("1.5", 2.0)], "s string, d double")
    got = df.select(
        to_number("s", "bigint").alias("i"), zero_if_missing("s").alias("z"),
        ratio(F.lit(1.0), "d").alias("r"), pct(F.lit(1.0), "d").alias("p"),
    ).collect()
    assert [r.i for r in got] == [5, None, None, None, None]
    assert [r.z for r in got] == [5.0, 0.0, 0.0, 0.0, 1.5]
    assert [r.r for r in got] == [None, 0.5, 0.5, 0.5, 0.5]
    assert got[1].p == 50.0
    hours = spark.sql("select explode(array(0L, 3599999999L, 3600000000L)) as t").select(hour_bucket("t"))
    assert [r[0] for r in hours.collect()] == [0, 0, 1]


def test_fill_missing(spark):
    text = spark.createDataFrame(
        [("12", " ", "a", "1", "x"), ("bad", None, "\t", "0", "y"), ("5.0", "7", " b ", None, "z")],
        "time string, job_id string, user string, different_machines_restriction string, extra string",
    )
    got = fill_missing(text, table_schema("task_events")).collect()
    assert [r.time for r in got] == [12, 0, 0]
    assert [r.job_id for r in got] == [0, 0, 7]
    assert [r.user for r in got] == ["a", "unknown", " b "]
    assert [r.different_machines_restriction for r in got] == [True, False, None]
    assert [(r.cpu_request, r.machine_id, r.extra) for r in got] == [(0.0, 0, "x"), (0.0, 0, "y"), (0.0, 0, "z")]


def test_required_fields(spark):
    df = spark.createDataFrame([("", 1.0), (None, 1.0), ("a", None), ("a", 2.0)], "s string, d double")
    assert require_nonempty(df, ["s", "d"]).count() == 1
    assert require_fields(df, ["s"]).count() == 3
    assert valid_time(spark.createDataFrame([("1",), ("x",), (None,)], "time string")).count() == 1


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(6439592366, None, 0.1), (None, "u", None)], "job_id long, user string, cpu_request double")
    encoded = encode_events(df)
    assert [tuple(r) for r in encoded.collect()] == [
        ("6439592366", '{"job_id":6439592366,"cpu_request":0.1}'), (None, '{"user":"u"}'),
    ]
    assert decode_events(encoded, df.schema).collect() == df.collect()
    broken = spark.createDataFrame([("{oops",)], "value string")
    assert decode_events(broken, event_schema("job_events")).first().asDict() == dict.fromkeys(
        table_schema("job_events").fieldNames()
    )


@pytest.fixture
def tables(spark, tmp_path):
    return [
        read_table(spark, name, write_part(tmp_path / name, rows), position=True)
        for name, rows in (("job_events", job_rows()), ("task_events", task_rows()))
    ]


def test_replay_order(tables):
    ordered = replay_order(*tables).collect()
    keys = [(r.time, r.topic_rank, r.source_file, r.seq) for r in ordered]
    assert keys == sorted(keys) and len(keys) == len(job_rows()) + len(task_rows())


def test_replay_feed(tables):
    feed = event_replay(*tables).collect()
    assert [r.time for r in feed] == sorted(r.time for r in feed)
    assert len(feed) == len(job_rows()) + len(task_rows())
    for r in feed:
        record = json.loads(r.value)
        assert r.partition == r.time % 12 and r.key == str(record["job_id"]) and record["time"] == r.time
        assert ("task_index" in record) == (r.topic == "task-events")
        assert not set(record) & set(POSITION)
    first_task = next(json.loads(r.value) for r in feed if r.topic == "task-events")
    assert first_task["machine_id"] == 0 and first_task["disk_space_request"] == 0.0


def test_routing_by_job(tables):
    tasks = tables[1].drop(*POSITION)
    routed = route_events(tasks, by="job_id").select("key", "partition").distinct().collect()
    assert {(r.key, r.partition) for r in routed} == {("1", 1), ("2", 2), ("3", 3)}


def manifest(folder):
    commits = sorted((folder / "_spark_metadata").glob("[0-9]*"), key=lambda f: int(f.name.split(".")[0]))
    return [json.loads(line) for line in commits[-1].read_text().splitlines()[1:]]


def test_topic_files_follow_time(spark, tables, tmp_path):
    """Files hold ranges of time, and their manifest has them in order."""
    path = tmp_path / "topics"
    write_replay(*tables, files=4, path=str(path))
    for topic in ("job-events", "task-events"):
        listed = manifest(path / f"topic={topic}")
        assert len(listed) > 1 and sorted(e["modificationTime"] for e in listed) == [e["modificationTime"] for e in listed]
        lines = [line for e in listed for line in open(e["path"].removeprefix("file:")).read().splitlines()]
        times = [json.loads(line)["time"] for line in lines]
        assert times == sorted(times)


def order_read(spark, folder, name):
    """First record of each batch of a stream that takes a file at a time, by batch."""
    seen = {}
    df = read_topic(spark, "t", fmt="text", path=str(folder), maxFilesPerTrigger="1")
    query = df.writeStream.foreachBatch(lambda b, i: seen.update({i: [r.value for r in b.collect()]}))
    query.option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start().awaitTermination()
    return [seen[i] for i in sorted(seen)]


def test_commits_need_no_modification_times(spark, tmp_path):
    """The store's times run backwards; files are read as published, those of later commits after, unpublished ones not."""
    folder = tmp_path / "topic=t"
    folder.mkdir()

    def put(k):
        file = folder / f"part-{k:05d}.txt"
        file.write_text(f"record {k}\n")
        os.utime(file, (1_600_000_000 - 1000 * k, 1_600_000_000 - 1000 * k))

    for k in range(4):
        put(k)
    assert commit_in_order(spark, str(folder)) == 4 and commit_in_order(spark, str(folder)) == 0
    put(4)
    assert order_read(spark, tmp_path, "c") == [[f"record {k}"] for k in range(4)]
    for k in range(5, 18):  # more commits than a compact one takes
        assert commit_in_order(spark, str(folder)) == 1
        put(k)
    assert order_read(spark, tmp_path, "c") == [[f"record {k}"] for k in range(4, 17)]
    assert order_read(spark, tmp_path, "d") == [[f"record {k}"] for k in range(17)]
    assert spark.read.text(str(folder)).count() == 17
    assert commit_in_order(spark, str(tmp_path / "nowhere")) == 0


def test_events_without_a_time(spark):
    """They are filled and lead the feed, or are dropped."""
    jobs = spark.createDataFrame([(None, 1, 0), (5, 2, 0)], "time long, job_id long, event_type long")
    tasks = spark.createDataFrame([(3, 2, 0, 1), (None, 2, 1, 1)], "time long, job_id long, task_index long, event_type long")
    feed = event_replay(jobs, tasks, []).collect()
    assert [r.time for r in feed] == [0, 0, 3, 5]
    assert [r.time for r in event_replay(jobs, tasks, [], drop_untimed=True).collect()] == [3, 5]


def test_json_numbers(spark, tmp_path):
    """An exponent is part of a number."""
    rows = [(i, "2024-01-01 00:00:00", 1, "view", 1.0, p) for i, p in enumerate(['{"k": 1e-3}', '{"k": -2.5E2}', "{}", "no"])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.memory_request for r in Trace(spark, str(tmp_path)).task_events.collect()}
    assert got == {0: 1e-5, 1: -2.5, 2: None, 3: None}


def test_equal_part_names_in_two_folders(spark, tmp_path):
    for name in ("a", "b"):
        write_part(tmp_path / name, [[i, "", 1, 0, "u", 0, "", ""] for i in range(3)])
    df = read_table(spark, "job_events", [str(tmp_path / "a"), str(tmp_path / "b")], position=True)
    assert df.select("source_file").distinct().count() == 2
