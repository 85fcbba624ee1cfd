"""What a worker of the n-gram Jaccard join and of the removal of repeated passages holds at a time, and that smaller
blocks change no hash."""

from __future__ import annotations

import pickle
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from made import prose
from pyspark.sql.classic.dataframe import DataFrame

from tracemill.llm import jaccard_join, substring_dedup
from tracemill.llm.rolling import ASCII_SPACE, WordHasher


class Texts:
    """Stands for a DataFrame: runs the first step over batches, and keeps the peak in bytes."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, step, schema):  # noqa: N802
        tracemalloc.start()
        self.rows = sum(b.num_rows for b in step(iter(self.batches)))
        self.peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return self

    def select(self, *columns):
        return self

    groupBy = applyInPandas = select  # noqa: N815

    def toLocalIterator(self):  # noqa: N802
        return iter([])


def test_counting_takes_little_beside_the_sketch():
    texts = [" ".join(f"w{k}" for k in range(i, i + 1000)) for i in range(0, 1_000_000, 1000)]  # 8 MB
    docs = Texts([pa.record_batch([pa.array(texts)], ["text"])])
    jaccard_join._frequencies(docs, "text")
    assert docs.rows == jaccard_join.CELLS // jaccard_join.CHUNK
    assert docs.peak < 2 * jaccard_join.CELLS + (32 << 20)


def test_the_pairs_of_a_block_are_not_held_together():
    n, bits = 1000, [[1, 2]] * 1000  # all pairs are allowed
    name = random.Random(3).sample(range(-(10**15), 10**15), n)
    columns = [[5] * n, [0] * n, [0] * n, [0] * n, name, name, [30] * n]
    batch = pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(bits, pa.list_(pa.int64()))], list("tijospnb"))
    tracemalloc.start()
    found = 0
    for rows in jaccard_join._compared(iter([batch.slice(0, 300), batch.slice(300)])):
        assert (np.asarray(rows.column(0)) > np.asarray(rows.column(1))).all()
        found += rows.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * (n - 1) // 2 and peak < 16 << 20


def test_blocks_and_chunks_change_no_hash():
    rng = random.Random(4)
    texts = pa.array([None, "", "one", prose(rng, 3000), *(prose(rng, rng.randint(1, 200)) for _ in range(40)), "x" * 5000])

    def hashes(*sizes):
        hasher = WordHasher(ASCII_SPACE, True, *sizes)
        return np.concatenate([hasher.hashes(block) for block in hasher.blocks(texts)])

    assert (hashes() == hashes(1 << 10, 1 << 6)).all()


@pytest.fixture
def steps(monkeypatch):
    """By name, the functions that mapInArrow is called with."""
    steps = {}

    def kept(df, step, *args, made=DataFrame.mapInArrow, **named):
        steps[step.__name__] = step
        return made(df, step, *args, **named)

    monkeypatch.setattr(DataFrame, "mapInArrow", kept)
    return steps


def test_removal_of_passages_takes_little_beside_the_planes(spark, steps):
    """Counting and placing some 2,000,000 windows that all repeat, of 20 MB of text in batches of a few MB."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(1000)}" for _ in range(1000)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    result = substring_dedup.repeated_windows(docs)
    n = len(texts) * 981

    def peak(step, rows):
        batch = pa.record_batch([pa.array(texts * 10), pa.array(range(400), pa.int64())], ["text", "place"])
        tracemalloc.start()
        for out in step(batch for _ in range(5)):
            rows.append(out.num_rows)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    touched, places = [], []
    assert peak(steps["sketch"], touched) < 80 << 20 and sum(touched) == substring_dedup.DEPTH
    assert peak(steps["places"], places) < 96 << 20 and sum(places) == n
    assert [r["n_removed"] for r in result.orderBy("doc_id").collect()] == [0] * 40 + [1000] * 40


def test_a_task_that_sends_its_windows_in_several_goes(spark, steps, monkeypatch):
    """Of one text, more windows than a task holds."""
    rng = random.Random(6)
    texts = [prose(rng, 3000), prose(rng, 50), None, ""]
    rows = list(enumerate(texts * 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(substring_dedup, "FLUSH", 1 << 10)
    substring_dedup.repeated_windows(docs)
    batch = pa.record_batch([pa.array([t for _, t in rows]), pa.array([i for i, _ in rows], pa.int64())], ["text", "place"])
    merged = {}
    for out in steps["sketch"](iter([batch])):
        for row, chunk, touched, again in zip(*(out.column(k).to_pylist() for k in range(4))):
            merged.setdefault((row, chunk), []).append({"touched": touched, "again": again})
    assert all(len(pieces) == 9 for pieces in merged.values())  # 9,036 windows
    parts = [(*k, next(substring_dedup._merge(k, iter([pd.DataFrame(p)])))["bits"][0]) for k, p in merged.items()]
    sketch = pickle.loads(pickle.dumps(substring_dedup.Sketch(parts, substring_dedup.MIN_CELLS)))
    hasher = WordHasher(ASCII_SPACE, False)
    for block in hasher.blocks(batch.column(0)):
        at, _ = substring_dedup._estimated(block, hasher.hashes(block), sketch, 20)
        assert len(at) == len(block.window_starts(20)) == 9036
    first = {}
    for out in steps["places"](iter([batch])):
        for a, b, place, pos in zip(*(out.column(k).to_pylist() for k in range(4))):
            first.setdefault((a, b), []).append((place, pos))
    assert sorted(min(x) for x in first.values()) == [(0, k) for k in range(2981)] + [(1, k) for k in range(31)]
