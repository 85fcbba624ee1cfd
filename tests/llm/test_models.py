"""The learned operators: held-out accuracy, restoration, edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from made import prose
from tracemill.llm.cotraining import co_train, quality_scores
from tracemill.llm.rolling import ASCII_SPACE, WordHasher
from tracemill.llm.toxicity import Channel, Words, letter_model, restore, toxicity_scores

FOLDER = "/root/testdata/sf0.1"
INSULTS = ["idiot", "moron", "scum", "loser", "stupid", "worthless"]
DISGUISED = ["1d10t", "m0r0n", "s.c.u.m", "l o s e r", "stuuuupid", "w0rthle55"]


@pytest.fixture(scope="module")
def given(spark):
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels")]


@pytest.fixture(scope="module")
def toxic(spark):
    """Documents with insults, and labels for those below 600; the others disguise theirs."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(800):
        bad = i % 4 == 0
        words = prose(rng, 60).split()
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS if i < 600 else DISGUISED))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def accuracy(scores, labels, column: str, label: str) -> float:
    joined = scores.join(labels, "doc_id").where(f"{column}.held_out")
    return joined.agg(F.avg((F.col(f"{column}.predicted") == F.col(label)).cast("double"))).first()[0]


def test_toxicity_held_out(given):
    docs, labels = given
    scores = toxicity_scores(docs, labels)
    assert accuracy(scores, labels, "toxicity", "toxic") > 0.97
    joined = scores.join(labels, "doc_id").where("toxicity.held_out")
    assert joined.where("toxic = 1").agg(F.avg("toxicity.predicted")).first()[0] > 0.85


def test_toxicity_of_disguised_words(toxic):
    docs, labels = toxic
    scores = toxicity_scores(docs, labels.where("doc_id < 600")).where("doc_id >= 600").select("doc_id", "toxicity.*")
    for row in scores.collect():
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert row["predicted"] == int(row["doc_id"] % 4 == 0)


def test_restored_words(toxic):
    model = letter_model(toxic[0])
    assert [restore(w, model) for w in DISGUISED] == INSULTS
    assert [restore(w, model) for w in INSULTS] == INSULTS


def restored(model, text: str) -> set[str]:
    block = next(WordHasher(ASCII_SPACE, False).blocks(pa.array([text])))
    return {w for _, words in Channel(model).restored(block) for w in words.split()}


def test_spaced_and_mixed_words(toxic):
    """Word ends between spaced letters, look-alikes among them, short runs, look-alikes at the end."""
    model = letter_model(toxic[0])
    cases = {
        "you are a l o s e r": "loser", "x l o s 3 r, y": "loser", "w 0 r t h l e s s": "worthless", "1 d 1 0 t": "idiot",
        "s c u m l o s e r": "loser", "g o": "go", "t 0": "to", "an a$$ a$$!": "ass", "(m0r0n)": "moron", "1d10t!": "idiot",
    }
    assert {t: w for t, w in cases.items() if w not in restored(model, t)} == {}
    assert restored(model, "plain words, all of 1999 (and 2) 3.5") == set()


def test_long_disguises(toxic):
    """Runs and tokens of any length are restored, and every block of restored words is scored."""
    model = letter_model(toxic[0])
    assert {"worthless", "loser"} <= restored(model, " ".join("andofworthlessloserandof" * 20))
    assert "worthless" in restored(model, "and-of-w0rthless-the." * 20)
    n = 900_000
    (_, slots, doc), *_ = Words(model).blocks(pa.array(["m0ron " * n]))
    assert slots.shape[1] == len(doc) == 2 * n


def test_toxicity_edges(spark, toxic):
    docs, labels = toxic
    odd = [(None, "idiot moron"), (900, None), (900, ""), (901, "scum " * 20_000), (902, "x" * 300_000), (902, "x" * 300_000)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("own")).withColumn("toxicity", F.lit(1))
    found = toxicity_scores(rows, labels.unionByName(spark.createDataFrame([(None, 1), (5000, 1), (3, None)], labels.schema)))
    assert found.columns == ["doc_id", "text", "score", "toxicity"]
    assert found.count() == rows.count() and {r[0] for r in found.select("score").distinct().collect()} == {"own"}
    odd = {r["doc_id"]: r["toxicity"] for r in found.where("doc_id >= 900 or doc_id is null").collect()}
    assert odd[None]["predicted"] == odd[901]["predicted"] == 1 and odd[900]["predicted"] == odd[902]["predicted"] == 0
    assert not odd[None]["held_out"] and all(0 <= t["score"] <= 1 for t in odd.values())
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert {r[0] for r in toxicity_scores(docs, labels.limit(0)).select("toxicity.predicted").collect()} == {0}


def test_quality_held_out(given):
    docs, labels = given
    scores = quality_scores(docs, labels)
    joined = scores.withColumnRenamed("quality", "q").join(labels, "doc_id").where("q.held_out")
    right = joined.agg(F.avg((F.col("q.predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97
    lost = joined.where("quality = 1").agg(F.avg(1 - F.col("q.predicted"))).first()[0]
    assert lost < 0.02


def test_views_teach_each_other():
    """With a few labels, pseudo-labels of one view help the other."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000).astype(float)
    views = [y[:, None] + rng.normal(0, s, (2000, 1)) for s in (0.3, 0.8)]
    views = [np.c_[v, rng.normal(size=(2000, 10))] for v in views]
    known = np.full(2000, np.nan)
    known[:60] = y[:60]
    hold = np.arange(2000) % 3 == 0
    models, weights = co_train(views, known, hold)
    logits = np.stack([m.logit(v) for m, v in zip(models, views)], 1) @ weights[:2] + weights[2]
    assert ((logits > 0) == (y > 0.5))[60:].mean() > 0.9


def test_quality_edges(spark, documents, rows):
    docs = documents([*rows, (None, "some words"), (5, "again 5")]).withColumn("quality", F.lit("own"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = quality_scores(docs, labels)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert all(0 <= r[0] <= 1 for r in found.select("quality.score").collect())
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert {r[0] for r in quality_scores(docs, labels.limit(0)).select("quality.score").collect()} == {0.5}
