"""Near copies by bottom-k sketches against plain Python."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from made import prose
from tracemill.llm import bottom_k
from tracemill.llm.bottom_k import near_copies, op12_minhash_dedup

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(docs):
    return {i: (n, part, i == part) for i, (n, part) in brute.similar(docs, 80).items()}


def result(df):
    rows = df.collect()
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_made_documents(documents, rows):
    assert result(op12_minhash_dedup(documents(rows))) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(op12_minhash_dedup(docs)) == plain(own)


@pytest.mark.parametrize("block, estimated", [(2048, 8), (16, 8), (16, 0)])
def test_spread_groups(documents, monkeypatch, block, estimated):
    """Copies of one text with few to many changes, so that the typical one doesn't link with all; short ones too."""
    monkeypatch.setattr(bottom_k, "BLOCK", block)
    monkeypatch.setattr(bottom_k, "ESTIMATED", estimated)
    rng = random.Random(11)
    rows = []
    for length in (9, 30, 55, 70, 150, 600):
        base = prose(rng, length).split()
        for k in range(50):
            own = list(base)
            for _ in range(rng.randint(0, max(1, length // 30))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(own)))
    shared = prose(rng, 50)  # a passage of many documents
    rows += [(len(rows) + k, prose(rng, 60) + shared) for k in range(60)]
    rng.shuffle(rows)
    assert result(op12_minhash_dedup(documents(rows))) == plain(rows)


def test_odd_rows(spark, rows):
    """Repeated rows, one id with two texts, null ids, clashing names, no rows."""
    text, other = rows[10][1], rows[11][1]
    own = [(5, text), (5, text), (5, other), (2, text), (None, text), (None, other), (None, None), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in own], "doc_id long, text string, n int, `set` string")
    found = sorted(tuple(-1 if v is None else v for v in r) for r in near_copies(docs).collect())
    n, m = (brute.similar([(0, t)])[0][0] for t in (text, other))
    assert found == sorted([(5, n, 2, False), (5, n, 2, False), (5, m, 5, True), (2, n, 2, True), (-1, n, 2, False), (-1, m, 5, False),
                            (-1, 0, -1, True), (8, 0, 8, True), (8, 0, 8, True)])
    assert near_copies(docs.where(F.lit(False))).collect() == []


def test_listed_values_meet():
    """Sets that share enough of their sketches share a listed value, whatever the order of the corpus."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        universe = rng.choice(1 << 40, 200, replace=False).astype(np.uint64)
        often = {int(v): int(rng.integers(0, 50)) for v in universe}
        x = np.sort(universe[:n])
        y = np.sort(np.r_[x[rng.random(n) > 0.1], universe[150 : 150 + n // 20]])
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < 80 * len(np.union1d(x, y)):
            continue
        a, b = x[: bottom_k.K], y[: bottom_k.K]
        assert bottom_k._passes(a, b)
        listed = [sorted(s.tolist(), key=lambda v: (often[v], s.tolist().index(v)))[: bottom_k._listed_values(len(w))] for s, w in ((a, x), (b, y))]
        assert set(listed[0]) & set(listed[1])
