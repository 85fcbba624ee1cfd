"""Properties of the physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as spark_entry
from tracemill.operators.pairs import pair_events, pair_totals
from tracemill.plans.analyses import power_lost, scheduling_latency
from tracemill.registry.queries import all_queries
from tracemill.sources.adapters import Trace
from tracemill.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"
# Results of streams and scans are read back from what they wrote; their plans are not those of the work.
WRITERS = {k for k in all_queries() if k == "read_topic" or "_stream" in k or k.startswith("scan_")}
QUERIES = {k: v for k, v in spark_entry.queries().items() if k in all_queries() and k not in WRITERS}


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "MapInPandas"):
        assert operator not in text


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("jobs_by_class", {"event_id", "user_id"}),
        ("job_locality", {"event_id", "user_id", "event_type"}),
        ("peak_usage", {"ts", "user_id", "event_type", "value", "props"}),
        ("distribution", {"l_returnflag", "l_linestatus"}),
        ("scheduling_latency", {"event_id", "ts", "event_type"}),
    ],
)
def test_scans_read_only_needed_columns(spark, name, columns):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns


@pytest.mark.parametrize("name", ["scheduling_latency", "job_durations", "event_pair_totals"])
def test_pair_totals_use_one_shuffle_by_job_and_no_join(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


@pytest.mark.parametrize("name", ["power_lost", "long_jobs", "duration_histogram", "latency_by_hour", "adjacent_pairs_hot"])
def test_building_a_query_runs_no_job(spark, name):
    QUERIES[name](spark, FOLDER)  # reads the file's schema
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build-{name}", "")
    events = Trace(spark, FOLDER)
    if name == "power_lost":
        power_lost(events.machine_events)
    else:
        QUERIES[name](spark, FOLDER)
    jobs = list(tracker.getJobIdsForGroup(f"build-{name}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # one for the schema of each read


@pytest.mark.parametrize("name", ["long_jobs", "slow_scheduled_jobs"])
def test_totals_share_one_shuffle(spark, name):
    df = QUERIES[name](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_eviction_probability_is_one_aggregate(spark):
    text = plan(spark, "eviction_probability")
    assert text.count("FileScan") == 1 and text.count("hashpartitioning") == 1


@pytest.mark.parametrize("name", ["distribution", "job_locality", "peak_usage", "hopping_usage"])
def test_rows_are_aggregated_before_they_move(spark, name):
    assert re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*HashAggregate\([^\n]*partial_", plan(spark, name))


def test_first_groups_are_cut_down_before_they_move(spark):
    """Only the longest candidates of a key leave each task."""
    text = plan(spark, "long_jobs")
    assert re.search(r"Exchange hashpartitioning\(key[^\n]*\n[^\n]*WindowGroupLimit[^\n]*Partial", text)


def test_tables_bucketed_by_job_need_no_shuffle(spark):
    events = Trace(spark, FOLDER).job_events
    events.write.mode("overwrite").bucketBy(8, "job_id").saveAsTable("job_events_by_job")
    totals = pair_totals(pair_events(spark.table("job_events_by_job"), 1, 4))
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    assert totals.count() == pair_totals(pair_events(events, 1, 4)).count()
    spark.sql("drop table job_events_by_job")


def test_event_filters_reach_a_parquet_copy(spark, tmp_path):
    path = str(tmp_path / "jobs")
    Trace(spark, FOLDER).job_events.drop("event_id").write.parquet(path)
    text = scheduling_latency(read_table(spark, "job_events", path, fmt="parquet"))
    text = text._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type, \[0,1\]\)", text)
    assert re.search(r"ReadSchema: struct<time:bigint,job_id:bigint,event_type:bigint>", text)
