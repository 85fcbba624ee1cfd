"""Decontamination with many blocks of patterns, and odd rows."""

from __future__ import annotations

import random

import brute
from made import prose
from tracemill.llm.decontaminate import benchmark_hits


def test_one_search_at_a_time(spark, documents, rows):
    rng = random.Random(6)
    bench = [(i, " ".join(prose(rng, 40).split())) for i in range(20)]
    docs = documents([(i, f"{prose(rng, 30)} {bench[i % 20][1]}") for i in range(60)])
    found = benchmark_hits(docs, spark.createDataFrame(bench, "item_id long, text string"), max_patterns=50)
    plan = found._jdf.queryExecution().toString()
    assert plan.count("MapInArrow _searched") + plan.count("MapInArrow search") <= 1
    assert all(r["hits"]["n_hit"] >= 40 for r in found.collect())


def test_a_window_of_many_items(spark, documents):
    """The items of one window are dealt over the blocks too."""
    text = " ".join(f"w{k}" for k in range(13))
    bench = spark.createDataFrame([(i, text) for i in range(300)], "item_id long, text string")
    [row] = benchmark_hits(documents([(1, f"x {text} y")]), bench, max_patterns=20).collect()
    assert row["hits"]["items"] == sorted(map(str, range(300))) and row["hits"]["n_hit"] == 13


def test_odd_rows(spark, rows):
    """Repeated rows, null ids, clashing names; in one block and in many."""
    words = brute.ALNUM.findall(rows[20][1])
    texts = [(3, rows[20][1]), (3, rows[20][1]), (None, rows[20][1]), (4, None), (4, ""), (5, rows[21][1])]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in texts], "doc_id long, text string, hits string, `row` int")
    bench = spark.createDataFrame([(1, " ".join(words[2:30]), 7), (1, " ".join(words[2:30]), 7), (2, None, 7)], "item_id long, text string, hits int")
    want = [v for _, v in sorted(brute.contamination(list(enumerate(t for _, t in texts)), [(1, " ".join(words[2:30]))]).items())]
    for most in (500_000, 3):
        found = benchmark_hits(docs, bench, max_patterns=most)
        assert found.columns == ["doc_id", "text", "row", "hits"]
        got = sorted((r["hits"]["n_words"], r["hits"]["n_hit"], len(r["hits"]["items"]), r["hits"]["contaminated"]) for r in found.collect())
        assert got == sorted((a, b, c, e) for a, b, c, _, e in want)
