"""Registered queries: SQL where there is any, the pipeline against plain Python, and no Python where none is asked for."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import brute
import corpus_pipeline
from compare import connect, rows_of, types_of
from tracemill.llm import registry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.all_queries(), registry.all_oracles()


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(spark_entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = connect(FOLDER).sql(SQL[name]).to_arrow_table()
    names = want.column_names
    assert types_of(got.select(names)) == types_of(want)
    assert rows_of(got.select(names)) == rows_of(want)


@pytest.mark.parametrize("number", [1, 5, 7, 8, 9])
def test_native_plans(spark, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapPartitions", "CartesianProduct"))


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain Python, except which of the kept pass the method's own tests."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, FOLDER).write.parquet(path)
        made = spark.read.parquet(path)
        rows = made.collect()
        own = list(before.items())
        after = {r["doc_id"]: r["text"] for r in rows}
        if i < 4:
            assert made.columns == docs.columns and len(after) == len(rows)
        if i == 0:
            passed = {k for k, v in brute.quality(own).items() if not v[-1]}
            assert set(after) <= passed and len(after) > 0.9 * len(passed)
        elif i == 1:
            assert set(after) == {part for _, part in brute.similar(own).values()}
        elif i == 2:
            assert set(after) == {k for k, v in brute.contamination(own, bench).items() if not v[-1]}
        elif i == 3:
            assert set(after) == set(before)
            assert all(v[:3] == (0, 0, 0) for v in brute.secrets(list(after.items())).values())
            clean = {k for k, v in brute.secrets(own).items() if v[:3] == (0, 0, 0)}
            assert sum(after[k] != before[k] for k in clean) <= 0.02 * len(clean)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        else:
            assert all(before[r["doc_id"]] == r["text"] for r in rows) and abs(len(rows) / len(before) - 1) < 0.3
        if i < 4:
            assert all(after[k] == before[k] for k in after) or i == 3
        docs, before = made, after


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, documents, rows, tmp_path):
    odd = [*rows, *rows[10:14], (None, rows[10][1]), (None, None)]
    documents(odd).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    made = corpus_pipeline.run(spark, str(tmp_path)).where("copy = 1").collect()
    assert len({r["text"] for r in made}) == len(made) > 0
