"""Analyses on small trace files with answers worked out by hand."""

from __future__ import annotations

import pytest

from trace_files import job_rows, machine_rows, micros, task_rows, usage_rows, write_part
from tracemill.operators.join import join_request_usage
from tracemill.operators.pairs import event_pairs, pair_events
from tracemill.plans import analyses as an
from tracemill.sources.tables import POSITION, read_table


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("trace")
    tables = {
        "machine_events": machine_rows(),
        "job_events": job_rows(),
        "task_events": task_rows(),
        "task_usage": usage_rows(),
    }
    return {
        name: read_table(spark, name, write_part(root / name, rows), position=True)
        for name, rows in tables.items()
    }


def rows(df):
    return [tuple(r) for r in df.collect()]


def near(values, want, tolerance=1e-6):
    assert len(values) == len(want)
    for got, expected in zip(values, want):
        assert got == pytest.approx(expected, abs=tolerance)


def test_machines_by_cpu(trace):
    assert rows(an.machines_by_cpu(trace["machine_events"])) == [(0.25, 2), (0.5, 3), (1.0, 2)]
    assert rows(an.machines_by_cpu(trace["machine_events"], distinct=True)) == [
        (0.25, 1), (0.5, 2), (1.0, 1),
    ]


def test_power_lost(trace):
    result = rows(an.power_lost(trace["machine_events"], tie=POSITION))
    near(result[0], (0.5, 9.0, 5.555556))


def test_power_lost_without_downtime(spark, tmp_path):
    path = write_part(tmp_path / "m", [[0, 1, 0, "p", 1, 1], [micros(3600), 1, 2, "p", 1, 1]])
    near(rows(an.power_lost(read_table(spark, "machine_events", path)))[0], (0.0, 1.0, 0.0))


def test_marker_times_are_left_out_on_request(spark, tmp_path):
    events = [[0, 1, 0, "p", 1, 1], [micros(10), 1, 0, "p", 1, 1], [micros(3610), 1, 2, "p", 1, 1],
              [2**63 - 1, 1, 2, "p", 1, 1]]
    table = read_table(spark, "machine_events", write_part(tmp_path / "m", events))
    assert rows(an.power_lost(table, trace_only=True))[0][1] == pytest.approx(1.0)
    assert rows(an.power_lost(table))[0][1] > 1e9


def test_class_counts(trace):
    assert rows(an.tasks_by_class(trace["task_events"])) == [(0, 3), (1, 2)]
    assert rows(an.tasks_by_class(trace["task_events"], distinct=True)) == [(0, 2), (1, 1)]
    assert rows(an.jobs_by_class(trace["job_events"])) == [(0, 12)]
    assert rows(an.jobs_by_class(trace["job_events"], distinct=True)) == [(0, 4)]


def test_eviction_probability(trace):
    assert rows(an.eviction_probability(trace["task_events"])) == [(1, 0.5)]
    assert rows(an.eviction_probability(trace["task_events"], keep_zero=True)) == [(0, 0.0), (1, 0.5)]


def test_job_locality(trace):
    near(rows(an.job_locality(trace["task_events"]))[0], (2, 1, 66.666667, 33.333333))


def test_request_vs_usage(trace):
    joined = join_request_usage(trace["task_events"], trace["task_usage"], first_only=False)
    assert joined.count() == 5
    near(rows(an.request_vs_usage(trace["task_events"], trace["task_usage"]))[0], (5, 0.666667, 0.408248))


def test_request_vs_usage_first_only(trace):
    joined = join_request_usage(trace["task_events"], trace["task_usage"])
    assert joined.count() == 3
    pairs, cpu, _ = rows(an.request_vs_usage(trace["task_events"], trace["task_usage"], first_only=True))[0]
    assert pairs == 3
    frame = joined.toPandas()
    assert cpu == pytest.approx(frame.cpu_request.corr(frame.cpu_usage))


def test_peaks_vs_evictions(trace):
    machines = an.eviction_by_machine(trace["task_events"], trace["task_usage"]).orderBy("machine_id")
    got = rows(machines)
    near(got[0], (1, 1, 0.3, 0.15))
    near(got[1], (3, 1, 0.0, 0.3))
    assert rows(an.peaks_vs_evictions(trace["task_events"], trace["task_usage"])) == [(None, None)]
    kept = rows(an.eviction_by_machine(trace["task_events"], trace["task_usage"], keep_zero=True).orderBy("machine_id"))
    assert [r[1] for r in kept] == [1, 0, 1]


def test_scheduling_latency(trace):
    near(rows(an.scheduling_latency(trace["job_events"]))[0], (6, 5.466667, 10.933333))
    assert rows(an.slow_scheduled_jobs(trace["job_events"])) == [(4, 20.0), (2, 14.0)]
    events = pair_events(trace["job_events"], 0, 1)
    pairs = event_pairs(events, first_only=False)
    assert sorted(e / 1e6 for _, e in rows(pairs)) == [-8.5, 1.5, 1.8, 4.0, 14.0, 20.0]
    assert sorted(e / 1e6 for _, e in rows(event_pairs(events))) == [1.5, 1.8, 20.0]


def test_scheduling_latency_first_only(trace):
    near(rows(an.scheduling_latency(trace["job_events"], first_only=True))[0], (3, 23.3 / 3, 46.6 / 3))


def test_latency_by_hour(trace):
    near(rows(an.latency_by_hour(trace["job_events"], tie=POSITION))[0], (0, 2.4))
    per_job = an.latency_by_hour(trace["job_events"], tie=POSITION, per_job=True)
    near(rows(per_job)[0], (0, 2.433333))


def test_job_durations(trace):
    near(rows(an.job_durations(trace["job_events"]))[0], (3 + 0, 40.9, 81.8))
    near(rows(an.long_jobs(trace["job_events"]))[0], (1, 100.2))
    bins = rows(an.duration_histogram(trace["job_events"]).orderBy("bin"))
    assert len(bins) == 50 and sum(b[3] for b in bins) == 3
    near(bins[0][1:], (5.0, 6.904, 1))
    near(bins[49][1:], (98.296, 100.2, 1))


def test_no_pairs(trace, spark):
    none = trace["job_events"].filter("job_id < 0")
    assert rows(an.job_durations(none)) == [(0, None, None)]
    assert rows(an.long_jobs(none)) == []
    assert [r[3] for r in rows(an.duration_histogram(none))] == [0] * 50
