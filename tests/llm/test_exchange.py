"""The exchange of pseudo-labels over a table against plain Python, and samples that stay bounded."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from made import prose
from tracemill.llm import cotraining, toxicity
from tracemill.llm.cotraining import Logistic, Pool, Round, Table, co_train, quality_scores
from tracemill.llm.toxicity import toxicity_scores


@pytest.fixture(scope="module")
def features(spark, rows):
    """Features of made documents with shouting as the bad quality, as a table and as lists."""
    rng = random.Random(3)
    own = [(i, prose(rng, rng.randint(5, 90)).upper() if i % 3 == 0 else prose(rng, rng.randint(5, 90))) for i in range(120)]
    docs = spark.createDataFrame(
        [(i, i * 7, t, f"s{i % 3}", "en" if i % 2 else None, len(t)) for i, t in own],
        "id long, mark long, text string, source string, lang string, size long",
    )
    table = cotraining._features(docs.repartition(5))
    batch = table.orderBy("id").toArrow().combine_chunks().to_batches()[0]
    return table, cotraining._views(batch), np.array([float(i % 3 > 0) for i, _ in own])


def plain_logit(model: Logistic, x: list[float]) -> float:
    z = [min(max((v - m) / s, -20), 20) for v, m, s in zip(x, model.mean, model.scale)] + [1.0]
    return min(max(sum(a * b for a, b in zip(z, model.beta)), -30), 30)


def plain_round(views, rounds, models, shares):
    """Cuts of the next round, and per view the sums after it, document by document."""
    given = [[None] * len(views[0]) for _ in views]
    scores = [[plain_logit(m, x) for x in v.tolist()] for m, v in zip(models, views)]

    def replay(past):
        out = [[None] * len(views[0]) for _ in views]
        for r in past:
            before = [list(o) for o in out]
            for k in range(len(views[0])):
                if before[0][k] is None and before[1][k] is None:
                    for giver in (0, 1):
                        s = plain_logit(r.models[giver], views[giver][k].tolist())
                        if s >= r.cuts[giver][1]:
                            out[1 - giver][k] = 1.0
                        elif s <= r.cuts[giver][0]:
                            out[1 - giver][k] = 0.0
        return out

    given = replay(rounds)
    open_ = [k for k in range(len(views[0])) if given[0][k] is None and given[1][k] is None]
    cuts = []
    for i in (0, 1):
        own = sorted(scores[i][k] for k in open_)
        low, high = (own[max(math.ceil(share * len(own)) - 1, 0)] for share in shares)
        cuts.append((low + 1e-9, high - 1e-9))  # a score at the cut is rounded in its own way
    after = replay([*rounds, Round(models, cuts)])
    sums = []
    for i, model in enumerate(models):
        n, width = 0, len(model.beta)
        gradient, bound = [0.0] * width, np.zeros((width, width))
        for x, y in zip(views[i].tolist(), after[i]):
            if y is not None:
                z = [min(max((v - m) / s, -20), 20) for v, m, s in zip(x, model.mean, model.scale)] + [1.0]
                p = 1 / (1 + math.exp(-plain_logit(model, x)))
                gradient = [g + a * (y - p) for g, a in zip(gradient, z)]
                bound += 0.25 * np.outer(z, z)
                n += 1
        sums.append((n, gradient, bound))
    return cuts, sums


def test_rounds_against_plain(features):
    table, views, y = features
    models = [Logistic(v[:40], y[:40]) for v in views]
    pool, memory, rounds = Table(table), Pool(views), []
    for _ in range(3):
        shares = 0.1, 0.8
        cuts, sums = plain_round(views, rounds, models, shares)
        for own in (pool, memory):
            assert np.allclose(own.cuts(rounds, models, shares), cuts)
        rounds.append(Round([cotraining.copy(m) for m in models], cuts))
        for own in (pool, memory):
            for (n, gradient, bound), (m, g, b) in zip(own.sums(rounds, models), sums):
                assert n == m and np.allclose(gradient, g) and np.allclose(bound, b)
        for (n, gradient, bound), model in zip(sums, models):
            model.improve(np.array(gradient), bound + np.eye(len(bound)))


def test_wrong_labels_do_not_spread():
    """A view that knows nothing teaches nothing."""
    rng = np.random.default_rng(2)
    y = (rng.random(3000) < 0.85).astype(float)
    views = [np.c_[y + rng.normal(0, 0.2, 3000), rng.normal(size=(3000, 20))], rng.normal(size=(3000, 20))]
    known = np.where(np.arange(3000) < 1500, y, np.nan)
    models, weights = co_train(views, known, np.arange(3000) % 4 == 0)
    logits = np.stack([m.logit(v) for m, v in zip(models, views)], 1) @ weights[:2] + weights[2]
    assert ((logits > 0) == (y > 0.5))[1500:].mean() > 0.98


@pytest.fixture(scope="module")
def one_hot_id(spark):
    rng = random.Random(8)
    rows = [(i, f"{prose(rng, 30)} {'scum idiot' if i % 4 == 0 else ''}") for i in range(400)]
    rows += [(1, f"{prose(rng, 20)} {k}") for k in range(2000)] + [(2, "the same text")] * 1000
    docs = spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 3 > 0)) for i in range(400)], "doc_id long, toxic int, quality int")
    return docs.repartition(8), labels


def test_sample_of_texts_is_bounded(one_hot_id):
    """One id on most rows, with different texts or the same: one text of it is learned from."""
    docs, labels = one_hot_id
    known = labels.where("doc_id < 50").select(F.col("doc_id").alias("id"), "toxic")
    assert toxicity._learned(docs.select(F.col("doc_id").alias("id"), "text"), known).count() <= 50
    assert toxicity_scores(docs, labels).count() == docs.count()


def test_labelled_rows_are_bounded(one_hot_id, monkeypatch):
    docs, labels = one_hot_id
    seen = []
    monkeypatch.setattr(cotraining, "co_train", lambda views, y, hold, pool: (seen.append(len(y)), co_train(views, y, hold, pool))[1])
    assert quality_scores(docs, labels, labelled=100).count() == docs.count()
    assert seen == [100]
