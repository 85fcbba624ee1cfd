"""Groups cut into slices, and pairs counted without forming them, against brute force."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import pairs as pr
from tracemill.operators.aggregate import histogram
from tracemill.operators.join import request_usage_correlation
from tracemill.operators.sequence import adjacent_pairs
from tracemill.operators.skew import SLICE, ordered_slices
from tracemill.registry.queries import all_queries

EVENTS = "part long, time long, seq long, event_type long, carried double"


def brute_adjacent(events, a, b):
    out = []
    for part in {e[0] for e in events}:
        ordered = sorted((e for e in events if e[0] == part and e[1] is not None), key=lambda e: e[1:5])
        for x, y in zip(ordered, ordered[1:]):
            if x[3] == a and y[3] == b:
                out.append((part, x[4], x[1], y[1] - x[1]))
    return sorted(out, key=str)


def shapes():
    rng = random.Random(7)
    kinds = lambda: rng.choice([0, 0, 1, 1, 2])
    seq = iter(range(10**6))
    row = lambda part, time: (part, time, next(seq), kinds(), rng.random())
    hot_key = [row(1, rng.randrange(10**9)) for _ in range(400)]
    cold = [row(rng.randrange(2, 60), rng.randrange(10**9)) for _ in range(300)]
    one_instant = [row(1, 5) for _ in range(400)]
    burst = [row(1, 10**6 + rng.randrange(50)) for _ in range(400)]
    markers = [row(1, t) for t in (0, 0, 0, 2**63 - 1, 2**63 - 2)]
    return {
        "cold": cold,
        "hot key": hot_key + cold,
        "all at one instant": one_instant,
        "hot instant in a hot key": one_instant + hot_key + cold,
        "burst": burst + hot_key,
        "marker times": markers + hot_key + one_instant,
    }


@pytest.fixture(params=[2, 31])
def ranges(spark, request):
    """Few and many slices; without merging of small ones, so that they stay as many."""
    conf = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("shape", list(shapes()))
def test_adjacent_pairs(spark, shape, ranges):
    events = shapes()[shape]
    df = spark.createDataFrame(events, EVENTS).repartition(5)
    got = adjacent_pairs(df, "part", 0, 1, tie=["seq"], carry=["carried"])
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_adjacent(events, 0, 1)


def test_copies_without_tie_break(spark, ranges):
    """Copies of an event at one instant begin or end one pair, not several."""
    events = [(1, 5, 0, 0, 0.1)] * 50 + [(1, 5, 0, 0, 0.2)] * 50 + [(1, 5, 0, 1, 0.3)] * 50 + [(1, 9, 0, 1, 0.4)] * 50
    events += [(1, 20, 0, 0, None)] * 30 + [(1, 20, 0, 0, 0.5), (1, 30, 0, 1, 0.6)]
    df = spark.createDataFrame(events, EVENTS).repartition(5)
    got = adjacent_pairs(df, "part", 0, 1, carry=["carried"])
    assert sorted(map(tuple, got.collect())) == [(1, 0.2, 5, 0), (1, 0.5, 20, 10)]
    bare = adjacent_pairs(df, "part", 0, 1)
    assert sorted(map(tuple, bare.collect())) == [(1, 5, 0), (1, 20, 10)]


def test_ordering_columns_can_be_carried(spark, ranges):
    events = shapes()["hot instant in a hot key"]
    df = spark.createDataFrame(events, EVENTS)
    got = adjacent_pairs(df, "part", 0, 1, tie=["seq"], carry=["seq", "part", "carried"])
    assert got.columns == ["part", "seq", "carried", "time", "elapsed"]
    first = {e[2]: e for e in events}
    assert all((r.part, r.time, r.carried) == (first[r.seq][0], first[r.seq][1], first[r.seq][4]) for r in got.collect())
    assert got.count() == len(brute_adjacent(events, 0, 1))


def test_rows_without_key_or_time(spark, ranges):
    events = [(None, 1, 1, 0, 0.1), (None, 2, 2, 1, 0.2), (None, 9, 3, 0, 0.3), (None, 10, 4, 1, 0.4),
              (1, None, 5, 0, 0.5), (1, 3, 6, 1, 0.6)]
    df = spark.createDataFrame(events, EVENTS)
    got = adjacent_pairs(df, "part", 0, 1, tie=["seq"])
    assert sorted(r.elapsed for r in got.collect()) == [1, 1]


def sizes(sliced) -> list[int]:
    return [r["count"] for r in sliced.groupBy("part", SLICE).count().collect()]


def test_slices_are_small_and_ordered(spark, ranges):
    """One instant with text ties, two hot keys, and a hot key beside a long range of time."""
    rows = [(1, 0, f"part-{i % 7:05d}", i) for i in range(4000)]
    rows += [(k, t, "p", t) for k in (2, 3) for t in range(2000)]
    rows += [(4, 10**15 + i, "p", i) for i in range(2000)] + [(5, 0, "p", 0), (5, 2**62, "p", 1)]
    df = spark.createDataFrame(rows, "part long, time long, file string, seq long")
    sliced = ordered_slices(df, ["part"], ["time", "file", "seq"])
    assert max(sizes(sliced)) <= 2.5 * len(rows) / ranges
    for part in range(1, 6):
        own = sorted((tuple(r) for r in sliced.filter(f"part = {part}").collect()))
        numbers = [r[-1] for r in own]
        assert numbers == sorted(numbers)


def test_hot_keys_of_a_histogram_are_in_small_slices(spark, ranges):
    """A hot job whose times are short beside the global range."""
    rows = [(1, i, kind) for i in range(3000) for kind in (1, 4)] + [(2, 0, 1), (2, 10**15, 4)]
    events = pair_frame(spark, rows)
    got = pr.pair_histogram(events, pr.pair_totals(events))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(key" in plan and "Broadcast" not in plan.split("rangepartitioning(key")[0].split("Union")[-1]
    counts = [r["count"] for r in got.orderBy("bin").collect()]
    assert counts[0] == 9_000_000 and counts[-1] == 1 and sum(counts) == 9_000_001


def job_events(seed=3):
    rng = random.Random(seed)
    rows = [(1, rng.randrange(10**9), rng.choice([1, 4])) for _ in range(500)]
    rows += [(1, 77, 1)] * 100 + [(1, 10**8, 4)] * 50  # copies
    rows += [(2, rng.randrange(10**6), rng.choice([1, 4])) for _ in range(300)]
    rows += [(3, 5, 1)] * 200 + [(3, 900, 4)] * 200  # a key with one value
    rows += [(k, rng.randrange(10**9), rng.choice([0, 1, 2, 4])) for k in range(4, 60) for _ in range(5)]
    return rows


def brute_pairs(rows, start, end):
    return [(s[0], e[1] - s[1]) for s in rows for e in rows if s[0] == e[0] and s[2] == start and e[2] == end]


def pair_frame(spark, rows):
    df = spark.createDataFrame(rows, "job_id long, time long, event_type long").repartition(4)
    return pr.pair_events(df, 1, 4)


def test_pair_totals(spark):
    rows = job_events()
    pairs = brute_pairs(rows, 1, 4)
    events = pair_frame(spark, rows)
    totals = {r.key: r for r in pr.pair_totals(events).collect()}
    assert set(totals) == {k for k, _ in pairs}
    for key, r in totals.items():
        own = [e for k, e in pairs if k == key]
        assert (r.pairs, r.total, r.shortest, r.longest) == (len(own), sum(own), min(own), max(own))
    mean = pr.pair_mean(pr.pair_totals(events)).first()
    assert mean.pairs == len(pairs)
    assert mean["mean"] == pytest.approx(sum(e for _, e in pairs) / len(pairs) / 1e6)


@pytest.mark.parametrize("n", [1, 10, 300])
def test_longest_pairs(spark, n):
    rows = job_events()
    pairs = brute_pairs(rows, 1, 4)
    events = pair_frame(spark, rows)
    got = [tuple(r) for r in pr.longest_pairs(events, pr.pair_totals(events), n).collect()]
    assert got == sorted(pairs, key=lambda p: (-p[1], p[0]))[:n]


@pytest.mark.parametrize("formed", [0, 8, 10**6])
def test_pair_histogram(spark, ranges, formed, monkeypatch):
    """All keys counted, some, and none."""
    monkeypatch.setattr(pr, "FORMED", formed)
    rows, bins = job_events(), 50
    elapsed = [e for _, e in brute_pairs(rows, 1, 4)]
    lo, span = min(elapsed), max(elapsed) - min(elapsed)
    want = [0] * bins
    for e in elapsed:
        want[min((e - lo) * bins // span, bins - 1)] += 1
    events = pair_frame(spark, rows)
    got = pr.pair_histogram(events, pr.pair_totals(events), bins)
    assert [r["count"] for r in got.orderBy("bin").collect()] == want


def test_pair_histogram_bin_edges(spark):
    # Every pair lies on an edge between bins.
    rows = [(1, 0, 1)] * 30 + [(1, 100 * i, 4) for i in range(21)] * 3
    events = pair_frame(spark, rows)
    got = pr.pair_histogram(events, pr.pair_totals(events), 20)
    assert [r["count"] for r in got.orderBy("bin").collect()] == [90] * 19 + [180]


def test_histogram_of_one_value(spark):
    got = histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), "x", 10).orderBy("bin")
    counts = [(r.bin_start, r["count"]) for r in got.collect()]
    assert counts[0][0] == pytest.approx(1.5)
    assert [c for _, c in counts] == [0] * 5 + [2] + [0] * 4


def test_correlation_of_many_to_many_join(spark):
    rng = random.Random(5)
    task = lambda: (1, 1) if rng.random() < 0.4 else (rng.randrange(20), rng.randrange(2))
    requests = [(*task(), rng.random(), 0.1) for _ in range(200)]
    samples = [(*task(), rng.random(), rng.random()) for _ in range(300)]
    r = spark.createDataFrame(requests, "job_id long, task_index long, cpu_request double, memory_request double")
    s = spark.createDataFrame(samples, "job_id long, task_index long, cpu_usage double, memory_usage double")
    joined = r.join(s, ["job_id", "task_index"]).toPandas()
    got = request_usage_correlation(r, s).first()
    assert got.pairs == len(joined)
    assert got.cpu_correlation == pytest.approx(joined.cpu_request.corr(joined.cpu_usage), abs=1e-12)
    assert got.memory_correlation is None  # constant requests


def test_correlation_with_an_outlier(spark):
    """One value far from the others, in the first row, leaves the correlation its digits."""
    rng = random.Random(6)
    values = [(i, 0, 1e6 + rng.random(), 1 + rng.random()) for i in range(300)]
    r = spark.createDataFrame([(999, 0, 1e-9, 1.0), *values], "job_id long, task_index long, cpu_request double, memory_request double")
    s = spark.createDataFrame([(i, 0, c + rng.random() / 10, m) for i, _, c, m in values], "job_id long, task_index long, cpu_usage double, memory_usage double")
    joined = r.join(s, ["job_id", "task_index"]).toPandas()
    got = request_usage_correlation(r, s).first()
    assert got.cpu_correlation == pytest.approx(joined.cpu_request.corr(joined.cpu_usage), abs=1e-6)


@pytest.mark.parametrize(("year", "kind"), [(2024, "bigint"), (9999, "decimal(38,0)")])
def test_totals_of_hot_jobs_beyond_64_bits(spark, tmp_path, year, kind):
    """A total that fits is a long as in the SQL; one that doesn't is exact as well."""
    rows = [(3 * i, 3, "signup", "1000-01-01 00:00:00") for i in range(8)] + [(3 * i, 3, "click", f"{year}-01-01 00:00:00") for i in range(8, 16)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string")
    events.selectExpr("*", "1D as value", "'{}' as props").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = all_queries()["pair_totals_hot"](spark, str(tmp_path))
    days = (datetime.date(year, 1, 1) - datetime.date(1000, 1, 1)).days
    (row,) = got.collect()
    assert dict(got.dtypes)["total"] == kind and dict(got.dtypes)["pairs"] == "bigint"
    assert row["total"] == 64 * days * 86_400_000_000 and row["pairs"] == 64
