"""Quality by co-training a text view and a metadata view.

The text view describes what is written: its words, hashed, and characters, lines and
repetition. The metadata view describes the page: its source, language and size. Each view
has a logistic classifier that starts from a bounded sample of labelled documents. In every
round each classifier labels those of all unlabelled documents that it is surest of, for the
other to learn from. At the end both are calibrated on labelled documents that neither has
learned from, weighted by how well they do there, and score all documents.

The exchange runs over all unlabelled documents, copies counted once. A round asks Spark for
the scores at which the surest share begins, by a distributed quantile, and for the sums of
gradients and bounds of Hessians over the documents labelled so far, added up by task. Which documents
have been labelled, and how, follows from the classifiers and scores of the rounds before, so
nothing is written between rounds; the driver has these and the labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import small_batches, staged, whole_text
from tracemill.llm.rolling import ASCII_SPACE, WordHasher, windows

LABELLED = 10_000  # labelled documents to learn from, at most
ROUNDS, SURE = 5, 0.05  # share of the unlabelled that each view labels in a round
STEPS = 2  # of Newton's method in a round
RIGHT = 0.9  # share of the labelled documents that a view must get right where it labels others
TRUST = 1.0  # weight of all pseudo-labels, against that of all labels
BUCKETS = 32  # of hashed sources; languages have half as many
WORDS = 64  # buckets of hashed words
SHAPE = 18  # numbers about characters, words and lines
TEXT_FEATURES = SHAPE + WORDS
SLOTS = 16  # in which the sums of the tasks meet


def text_view(hasher: WordHasher, column: pa.Array) -> np.ndarray:
    """One row of ``TEXT_FEATURES`` numbers for each text."""
    kind = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 stop, 7 beyond ASCII
    kind[97:123], kind[65:91], kind[48:58], kind[[32, 9, 11, 12, 13]], kind[10] = 1, 2, 3, 4, 5
    kind[[ord(c) for c in ".,;:'\"?"]], kind[128:] = 6, 7
    out = []
    for block in hasher.blocks(column):
        word = hasher.hashes(block)
        three = windows(word, 3)
        length = block.end - block.start
        for (_, lo, hi), a, b in zip(block.texts(), block.offsets[:-1], block.offsets[1:]):
            n, size = hi - lo, int(b - a)
            row = np.zeros(TEXT_FEATURES)
            row[SHAPE:] = np.sqrt(np.bincount((word[lo:hi] >> np.uint64(32)).astype(np.int64) % WORDS, minlength=WORDS) / max(n, 1))
            if n:
                share = np.bincount(kind[block.data[a:b]], minlength=8) / size
                own = word[lo:hi]
                lines = share[5] * size + 1
                first = kind[block.data[block.start[lo:hi]]]
                last = kind[block.data[block.end[lo:hi] - 1]]
                phrase = three[lo : hi - 2] if n > 2 else own
                mean = length[lo:hi].mean()
                row[:SHAPE] = [
                    *share, np.log1p(n), mean, length[lo:hi].std() / mean, len(np.unique(own)) / n ** 0.9,
                    len(np.unique(phrase)) / len(phrase), (first == 2).mean(), (last == 0).mean(), (first == 0).mean(),
                    np.log1p(n / lines), (length[lo:hi] == 1).mean(),
                ]
            out.append(row)
    return np.array(out).reshape(-1, TEXT_FEATURES)


def metadata_places(source: list, lang: list, n_chars: list) -> tuple[np.ndarray, ...]:
    """Buckets of source and language, and the logarithm of the size; a null is a value of its own."""

    def hashed(values: list, buckets: int) -> np.ndarray:
        at = pd.util.hash_array(np.array([str(v) for v in values], dtype=object), categorize=True) % buckets
        return at.astype(np.int32)

    size = np.log1p(np.maximum(np.array([0 if v is None else v for v in n_chars], float), 0)) / 5
    return hashed(source, BUCKETS), hashed(lang, BUCKETS // 2), size


def metadata_view(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.c_[np.eye(BUCKETS)[source].reshape(-1, BUCKETS), np.eye(BUCKETS // 2)[lang].reshape(-1, BUCKETS // 2), size, size**2, size**3]


class Logistic:
    """Logistic regression on features that are standardised as in the first rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 2.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.beta = np.zeros(x.shape[1] + 1)
        self.ridge = np.full(len(self.beta), penalty)
        self.ridge[-1] = 1e-3
        for _ in range(30):
            if np.abs(self.improve(*self.sums(x, y))).max() < 1e-6:
                break

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.scale, -20, 20), np.ones(len(x))]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.rows(x) @ self.beta, -30, 30)

    def sums(self, x: np.ndarray, y: np.ndarray, bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the log-likelihood, without the penalty, or the bound of the Hessian for
        all coefficients, with which no step overshoots, however wrong some labels are."""
        z = self.rows(x)
        p = _chance(np.clip(z @ self.beta, -30, 30))
        return z.T @ (y - p), (z * (0.25 if bound else (p * (1 - p))[:, None])).T @ z

    def improve(self, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
        """One step of Newton's method."""
        step = np.clip(np.linalg.solve(hessian + np.diag(self.ridge), gradient - self.ridge * self.beta), -5, 5)
        self.beta = self.beta + step
        return step


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


class Round(NamedTuple):
    """Both classifiers, and for each the scores up to and from which it labels."""

    models: list[Logistic]
    cuts: list[tuple[float, float]]


def targets(views: list[np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """For each view the labels that the other has given it in these rounds; nan without one."""
    out = [np.full(len(views[0]), np.nan) for _ in views]
    for models, cuts in rounds:
        open_ = np.isnan(out[0]) & np.isnan(out[1])
        for giver, (low, high) in enumerate(cuts):
            score = models[giver].logit(views[giver])
            out[1 - giver][open_ & (score <= low)] = 0.0
            out[1 - giver][open_ & (score >= high)] = 1.0
    return out


def open_scores(views: list[np.ndarray], rounds: list[Round], models: list[Logistic]) -> list[np.ndarray]:
    """Both classifiers' scores of the documents that no round has labelled."""
    given = targets(views, rounds)
    open_ = np.isnan(given[0]) & np.isnan(given[1])
    return [m.logit(x[open_]) for m, x in zip(models, views)]


def pool_sums(views: list[np.ndarray], rounds: list[Round], models: list[Logistic]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each view: how many documents have a label for it, gradient and Hessian over these."""
    out = []
    for x, y, model in zip(views, targets(views, rounds), models):
        known = ~np.isnan(y)
        out.append((int(known.sum()), *model.sums(x[known], y[known], bound=True)))
    return out


class Pool:
    """Unlabelled documents in memory."""

    def __init__(self, views: list[np.ndarray]):
        self.views = views

    def cuts(self, rounds: list[Round], models: list[Logistic], shares: tuple[float, float]) -> list[tuple[float, float]]:
        scores = open_scores(self.views, rounds, models)
        return [tuple(np.quantile(s, shares, method="inverted_cdf")) if len(s) else (0.0, 0.0) for s in scores]

    def sums(self, rounds: list[Round], models: list[Logistic]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return pool_sums(self.views, rounds, models)


class Table(Pool):
    """Unlabelled documents in a table of features."""

    def __init__(self, features: DataFrame):
        self.features = features

    def cuts(self, rounds, models, shares):
        shared = self.features.sparkSession.sparkContext.broadcast((rounds, models))

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(s) for s in open_scores(_views(batch), *shared.value)], ["s0", "s1"])

        found = self.features.mapInArrow(scores, "s0 double, s1 double").agg(
            *[F.percentile_approx(f"s{i}", [float(s) for s in shares], 10_000).alias(f"s{i}") for i in range(2)]
        )
        row = found.first()
        return [tuple(row[f"s{i}"]) if row[f"s{i}"] else (0.0, 0.0) for i in range(2)]

    def sums(self, rounds, models):
        shared = self.features.sparkSession.sparkContext.broadcast((rounds, models))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list | None = None
            for batch in batches:
                own = pool_sums(_views(batch), *shared.value)
                total = own if total is None else [tuple(a + b for a, b in zip(x, y)) for x, y in zip(total, own)]
            for i, (n, gradient, hessian) in enumerate(total or []):
                sums = pa.array([np.r_[n, gradient, hessian.ravel()]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), sums], ["view", "sums"])

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"view": part["view"][:1], "sums": [np.sum(np.stack(part["sums"]), axis=0)]})

        slot = F.pmod(F.spark_partition_id(), F.lit(SLOTS))
        parts = self.features.mapInArrow(each, "view int, sums array<double>").withColumn("slot", slot)
        out = [(0, np.zeros(len(m.beta)), np.zeros((len(m.beta), len(m.beta)))) for m in models]
        for row in parts.groupBy("view", "slot").applyInPandas(lambda p: add(p), "view int, sums array<double>").collect():  # 2 * SLOTS rows
            i, sums = row["view"], np.array(row["sums"])
            k = len(models[i].beta)
            own = int(sums[0]), sums[1 : k + 1], sums[k + 1 :].reshape(k, k)
            out[i] = tuple(a + b for a, b in zip(out[i], own))
        return out


def _right(cuts: tuple[float, float], score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cuts beyond which enough of the labelled documents are what the classifier says; none where they aren't."""
    low, high = cuts
    if low >= high:
        return -np.inf, np.inf
    below, above = 1 - y[score <= low], y[score >= high]
    return low if not len(below) or below.mean() >= RIGHT else -np.inf, high if not len(above) or above.mean() >= RIGHT else np.inf


def co_train(
    views: list[np.ndarray], y: np.ndarray, hold: np.ndarray, pool: Pool | None = None
) -> tuple[list[Logistic], np.ndarray]:
    """Classifiers of both views, and weights of their logits and an intercept.

    ``y`` has the labels, and nan for unlabelled rows, which are the pool if none is given;
    ``hold`` marks labelled rows kept for calibration."""
    known = ~np.isnan(y)
    learn, judged = known & ~hold, known & hold
    pool = pool or Pool([x[~known] for x in views])
    models = [Logistic(x[learn], y[learn]) for x in views]
    prior = y[learn].mean()
    shares = SURE * (1 - prior), 1 - SURE * prior
    rounds: list[Round] = []
    for _ in range(ROUNDS):
        cuts = [_right(c, m.logit(x[known]), y[known]) for c, m, x in zip(pool.cuts(rounds, models, shares), models, views)]
        rounds.append(Round([copy(m) for m in models], cuts))
        for _ in range(STEPS):
            for (n, gradient, hessian), model, x in zip(pool.sums(rounds, models), models, views):
                weight = min(1.0, TRUST * learn.sum() / max(n, 1))
                own = model.sums(x[learn], y[learn], bound=True)
                model.improve(own[0] + weight * gradient, own[1] + weight * hessian)
    if not 0 < y[judged].sum() < judged.sum():
        return models, np.array([0.5, 0.5, 0.0])
    logits = np.stack([m.logit(x[judged]) for m, x in zip(models, views)], 1)
    both = Logistic(logits, y[judged], 1.0)
    weights = both.beta[:-1] / both.scale
    return models, np.r_[weights, both.beta[-1] - (weights * both.mean).sum()]


FEATURES = "id long, mark long, x array<float>, source int, lang int, size double"


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of rows of ``FEATURES``."""
    x = batch.column("x").flatten().to_numpy().reshape(-1, TEXT_FEATURES).astype(float)
    return [x, metadata_view(*[batch.column(c).to_numpy() for c in ("source", "lang", "size")])]


def _features(docs: DataFrame) -> DataFrame:
    """Rows of ``FEATURES`` of rows (id, mark, text, source, lang, size)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ASCII_SPACE, True)
        for batch in batches:
            x = text_view(hasher, batch.column(2)).astype(np.float32)
            places = metadata_places(*[batch.column(i).to_pylist() for i in (3, 4, 5)])
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * TEXT_FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), *map(pa.array, places)],
                ["id", "mark", "x", "source", "lang", "size"],
            )

    return docs.mapInArrow(features, FEATURES)


def quality_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    source: str = "source", lang: str = "lang", size: str = "n_chars",
    labelled: int = LABELLED,
) -> DataFrame:
    """``docs`` with ``quality``: held_out, text_score, page_score, score and predicted.

    Learns from at most ``labelled`` labelled documents, those with the smallest hashes of
    their ids, and from all unlabelled ones, copies counted once; never from one whose
    crc32(id as text) mod 5 is 0. All documents are scored, 1 being good.

    Ids are integers. Null metadata are values of their own; a null or empty text has a text view of zeros.
    Each row is scored by itself, so repeated rows and ids stay; a null id is not held
    out. Other columns stay, a column named ``quality`` is replaced. Null labels are not
    used; an id with several labels has the largest, and one with several texts teaches by
    that with the smallest hash. Without labelled documents of both
    classes the scores are the share of good ones, or 0.5. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    id_ = F.col(key).cast("long")
    fold = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(5))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(id_.alias("id")).agg(F.max(F.col(label).cast("double")).alias("y"))
    known = known.where(fold(F.col("id")) != 0)

    columns = [whole_text(text).alias("text"), F.col(source).cast("string").alias("source"),
               F.col(lang).cast("string").alias("lang"), F.col(size).cast("long").alias("size")]
    rows = docs.select(id_.alias("id"), *columns).withColumn("mark", F.xxhash64("text", "source", "lang", "size"))
    # A null id is in no fold and can't be labelled.
    rows = rows.where(F.coalesce(fold(F.col("id")) != 0, F.lit(True)))
    features = staged(_features(rows.select("id", "mark", "text", "source", "lang", "size")), "quality-features")
    sample = staged(known.orderBy(F.xxhash64("id"), "id").limit(labelled), "quality-sample")  # a bounded sample, by design
    fit = features.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min(F.struct("mark", "x", "source", "lang", "size")).alias("f"))
    fit = fit.select("id", "y", "f.*").toArrow().sort_by("id").combine_chunks()  # ``labelled`` rows at most
    others = features.join(known.select("id"), "id", "left_anti").dropDuplicates(["mark"])
    y, ids = fit.column("y").to_numpy(), fit.column("id").to_numpy()
    hold = ids % 4 == 0
    if (~hold).any() and 0 < y[~hold].sum() < (~hold).sum():
        pool = Table(staged(others, "quality-pool"))
        parts = co_train(_views(fit.to_batches()[0]), y, hold, pool)
    else:
        parts = None, np.array([float(y.mean()) if len(y) else 0.5])
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    kept = [c for c in docs.columns if c != "quality"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (models, weights) = WordHasher(ASCII_SPACE, True), shared.value
        k = len(kept)
        for batch in batches:
            n = batch.num_rows
            if models is None:
                scores = [np.full(n, weights[0])] * 3
            else:
                places = metadata_places(*[batch.column(k + i).to_pylist() for i in (1, 2, 3)])
                view = text_view(hasher, batch.column(k)), metadata_view(*places)
                logits = [m.logit(x) for m, x in zip(models, view)]
                scores = [_chance(v) for v in (*logits, np.stack(logits, 1) @ weights[:2] + weights[2])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], *[pa.array(s, pa.float64()) for s in scores]],
                [*[f"c{i}" for i in range(k)], "text_score", "page_score", "score"],
            )

    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    given = docs.select(*kept, *[c.alias(f"__view_{i}") for i, c in enumerate(columns)])
    out = given.mapInArrow(score, f"{fields}, text_score double, page_score double, score double")
    result = F.struct(
        F.coalesce(fold(F.col(f"c{kept.index(key)}")) == 0, F.lit(False)).alias("held_out"),
        "text_score", "page_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], result.alias("quality"))


def op4_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs, labels).select("doc_id", "quality.*")
