"""Options of the generic operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.operators import aggregate as agg
from tracemill.operators.join import join_counts, scalar_row
from tracemill.operators.order import first_n
from tracemill.operators.sequence import above_mean
from tracemill.session import SETTINGS, prepare, shared_folder


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 1.0, None), ("b", 3.0, 6.0), ("b", 5.0, 10.0), (None, 9.0, 18.0)],
        "k string, x double, y double",
    )


def test_distinct_per_key(numbers):
    exact = {r.k: r.distinct for r in agg.distinct_per_key(numbers, "k", "x").collect()}
    approx = {r.k: r.distinct for r in agg.distinct_per_key(numbers, "k", "x", approx=True).collect()}
    assert exact == approx == {"a": 1, "b": 2, None: 1}


def test_one_or_several(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (3, None)], "k long, v long")
    assert {r.k: r["values"] for r in agg.one_or_several(df, "k", "v").collect()} == {1: 1, 2: 2, 3: 0}


def test_pearson_edge_cases(spark, numbers):
    assert agg.pearson(numbers, "x", "y").first()[0] == pytest.approx(1.0)
    constant = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 3.0)], "x double, y double")
    assert agg.pearson(constant, "x", "y").first()[0] is None
    assert agg.pearson(constant.limit(1), "x", "y").first()[0] is None


def test_summary_and_scalar_row(numbers):
    row = scalar_row(agg.summary(numbers, "x"), numbers.agg(F.count("*").alias("n"))).first()
    assert (row["sum"], row["min"], row["max"], row["mean"], row["n"]) == (19.0, 1.0, 9.0, 3.8, 5)


def test_above_mean_is_strict(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,)], "x double")
    assert [r.x for r in above_mean(df, "x").collect()] == [5.0]
    assert above_mean(df, "x", k=2.5).count() == 0
    assert [r.x for r in first_n(df, [F.desc("x")], 2).collect()] == [5.0, 1.0]


def test_join_counts(numbers):
    a, b = agg.distribution(numbers, "k"), agg.distribution(numbers.filter("x > 2"), "k", alias="big")
    assert {r.k for r in join_counts(a, b, "k").collect()} == {"b"}
    assert {r.k for r in join_counts(a, b, "k", "left").collect()} == {"a", "b", None}


def test_histogram_adds_up(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    bins = agg.histogram(df, "x", 7).orderBy("bin").collect()
    assert sum(b["count"] for b in bins) == 1000
    assert bins[0].bin_start == 0.0 and bins[-1].bin_end == pytest.approx(96.0)


def test_shared_folder_is_below_the_configured_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(f"{root}/x-")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_prepare(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    prepare(other)
    assert all(other.conf.get(k) == v for k, v in SETTINGS.items())
