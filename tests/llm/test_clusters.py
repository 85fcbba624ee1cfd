"""Clusters of vectors against plain Python, and the search against measuring every centroid."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tracemill.llm.centroid_clusters import Centroids, cluster_vectors, op11_centroid_clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, clusters=16, rounds=3, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(2**27), min(2**27, math.floor(64 * float(np.float32(x))))) for x in v]))
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        at = [[sum(x) // len(x) for x in zip(*vs)] if vs else c for c, vs in zip(at, own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = [sum(d for _, j, d in found if j == c) for c in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, sums[j], sum(sums), sha[j]) for i, j, d in found), key=str)


def made():
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 6]]) for i in range(300)]
    hot = [round(x, 1) for x in centres[0]]
    rows += [(300 + i, hot) for i in range(150)]  # a third are one vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65), (904, [None] + [0.0] * 63), (905, [math.nan] * 64)]
    rows += [(906, [math.inf] + [0.0] * 63), (907, [0.0] * 64), (908, [-0.0] * 64), (909, [3e38] + [0.0] * 63)]
    return rows


def test_against_plain(spark):
    rows = made()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, op11_centroid_clusters(df).collect()), key=str)
    assert got == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    rows = made()[:n] + [(900, None)]
    got = op11_centroid_clusters(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_other_parameters(spark):
    rows = [(i, [(i * 7 % 11) / 8, (i * 5 % 13) / 8]) for i in range(100)]
    out, at = cluster_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), clusters=4, rounds=5, size=2)
    assert len(at) == 4
    assert sorted(map(tuple, out.collect())) == sorted(r[:3] for r in plain(rows, 4, 5, 2))


@pytest.mark.parametrize("seed", range(4))
def test_search_and_bounds(seed):
    """Every round's state against all distances, with equal centroids and ties."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-6, 7, (400, 3))
    at = x[rng.integers(0, 400, 9)].astype(np.int64)
    at[4] = at[2]
    state = [np.zeros(400, np.int32), np.ones(400, np.int32), np.full(400, np.inf), np.zeros(400)]
    before = None
    for _ in range(6):
        Centroids(at, before).assign(x, *state)
        every = ((x[:, None] - at) ** 2).sum(2)
        assert (state[0] == every.argmin(1)).all()
        d = np.sqrt(every)
        own = d[np.arange(400), state[0]]
        d[np.arange(400), state[0]] = np.inf
        assert (state[2] >= own - 1e-6).all() and (state[3] <= d.min(1) + 1e-6).all()
        before, at = at, np.clip(at + rng.integers(-2, 3, at.shape), -8, 8)
