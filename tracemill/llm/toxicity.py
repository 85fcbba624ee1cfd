"""Toxicity by noisy-channel restoration of disguised words.

A disguised word is one that the channel may have changed: letters replaced by look-alikes
(``1d10t``), set apart (``i.d.i.o.t``, ``i d i o t``), or repeated (``idiooot``). Its
characters form a lattice: a look-alike stands for one of some letters, a separator or
space for nothing or the end of a word, a run of one letter for one or two. Viterbi search
finds the likeliest path under a letter trigram model counted over all documents, and the
likeliest without word ends. In letters set apart by spaces a word may begin at any of them,
where the model can't tell. The score is taken from the words and all restored words.

Evidence is learned from labelled documents: the words and beginnings of words that
occur in clearly more toxic documents than others. A document's evidence is calibrated by
a logistic function, on evidence that comes from the other half of the labelled documents.

Runs and tokens of any length are restored; all of the text is scored as it stands besides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import small_batches, staged, whole_text
from tracemill.llm.rolling import ASCII_NOT_ALNUM, ASCII_SPACE, Block, WordHasher, mix, windows

SAMPLE = 20_000  # labelled documents to learn from, at most
SLOTS, CHUNK = 1 << 22, 1 << 18  # of hashed words and beginnings
BEGINNINGS = [4, 5, 6, 7, 8]  # bytes
LEAST_DOCUMENTS, LEAST_ODDS = 5, 2.5
CACHED = 80  # characters of a token whose restoration is kept

# Letters that a look-alike may stand for, likelier ones first.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c",
}
SEPARATORS = ".-_*~'/\\"
GAPS = SEPARATORS + " \t\n\v\f\r"
NO_GAPS = str.maketrans("", "", GAPS)
MARKS = "!("  # look-alikes that are punctuation at the edge of a word
AROUND = "\"',.;:?)[]{}#%&*"  # punctuation at the edge of a word
LETTERS = "abcdefghijklmnopqrstuvwxyz"


# --- the language model -------------------------------------------------------------


def _symbols() -> np.ndarray:
    """Bytes as 1 to 26 for letters, 27 for bytes beyond ASCII, 0 for the rest."""
    out = np.zeros(256, np.int32)
    for i, c in enumerate(LETTERS):
        out[ord(c)] = out[ord(c.upper())] = i + 1
    out[128:] = 27
    return out


def letter_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Logarithms of the chance of a letter after two others, from all texts: 28 x 28 x 28."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, hasher, counts = _symbols(), WordHasher(ASCII_SPACE, False), np.zeros(28**3, np.int64)
        for batch in batches:
            for block in hasher.blocks(batch.column(0)):
                for lo in range(0, len(block.data), 1 << 20):
                    s = symbol[block.data[lo : lo + (1 << 20) + 2]]
                    counts += np.bincount((s[:-2] * 28 + s[1:-1]) * 28 + s[2:], minlength=28**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["trigram", "n"])

    counts = np.zeros(28**3)
    found = docs.select(whole_text(text).alias("text")).mapInArrow(count, "trigram int, n long")
    for row in found.groupBy("trigram").agg(F.sum("n").alias("n")).collect():  # at most 28^3 rows
        counts[row["trigram"]] = row["n"]
    return _log_chances(counts.reshape(28, 28, 28))


def _log_chances(counts: np.ndarray) -> np.ndarray:
    """Trigram chances, with pair and single chances where there is little to count."""
    single = (counts.sum((0, 1)) + 1) / (counts.sum() + 28)
    pair = (counts.sum(0) + 20 * single) / (counts.sum((0, 2))[:, None] + 20)
    return np.log((counts + 20 * pair[None]) / (counts.sum(2)[:, :, None] + 20))


def _lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """What each part of a token may stand for, with costs; a space ends a word."""
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and (token[j] in GAPS if c in GAPS else token[j] == c):
            j += 1
        if c in GAPS:
            yield [("", 0.0), (" ", 0.0)]
        elif c in LOOK_ALIKES:
            own = [(x, -0.5 * k) for k, x in enumerate(LOOK_ALIKES[c])]
            mark = c in MARKS and (i == 0 or token[i - 1] in GAPS or j == len(token) or token[j] in GAPS)
            yield from [[*own, (" ", 0.0)] if mark else own] * (j - i)
        elif c.isascii() and not c.isalnum():
            yield [(" ", 0.0)]
        elif j - i >= 3:
            yield [(c, 0.0), (c + c, -0.7)]
        else:
            yield [(c * (j - i), 0.0)]
        i = j


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a disguised token, with a space between words."""
    number = lambda x: ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27
    # Paths share their beginnings, so a token of any length takes space for its length alone.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for column in _lattice(token):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (p, q), (score, before) in paths.items():
            for letters, cost in column:
                a, b, total = p, q, score + cost
                for x in letters:
                    n = number(x)
                    total += model.item(a, b, n)
                    a, b = b, n
                if (a, b) not in following or following[a, b][0] < total:
                    following[a, b] = (total, (before, letters) if letters else before)
        paths = following
    _, node = max(((score + model[p, q, 0], node) for (p, q), (score, node) in paths.items()), key=lambda x: x[0])
    out = []
    while node is not None:
        node, letters = node
        out.append(letters)
    return " ".join("".join(reversed(out)).split())


# --- disguised words ------------------------------------------------------------------


class Channel:
    """Finds the disguised words of a block and restores them."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}
        kind = np.zeros(256, np.uint8)
        for c in LETTERS + LETTERS.upper():
            kind[ord(c)] = 1
        for c in LOOK_ALIKES:
            kind[ord(c)] = 2
        for c in SEPARATORS:
            kind[ord(c)] = 3
        self.kind = kind
        self.mark = np.zeros(256, bool)
        self.mark[[ord(c) for c in MARKS + AROUND + SEPARATORS]] = True

    def _signs(self, block: Block) -> np.ndarray:
        """Numbers of the words with a sign of disguise."""
        data = np.concatenate([block.data, np.zeros(3, np.uint8)])
        kind = self.kind[data]
        a, b, c = kind[:-3], kind[1:-2], kind[2:-1]
        fold = data | 32
        sign = (a == 3) & (b == 1) & (c == 3)
        sign |= (a == 1) & (b == 1) & (c == 1) & (fold[:-3] == fold[1:-2]) & (fold[1:-2] == fold[2:-1])
        at = np.concatenate([np.flatnonzero(sign), self._mixed(block)])
        word = np.unique(np.searchsorted(block.start, at, "right") - 1)
        return word[word >= 0]

    def _mixed(self, block: Block) -> np.ndarray:
        """Beginnings of the words with letters and look-alikes."""
        kind = self.kind[block.data]
        word = np.unique(np.searchsorted(block.start, np.flatnonzero(kind == 2), "right") - 1)
        letters = np.r_[0, np.cumsum(kind == 1, dtype=np.int64)]
        return block.start[word][letters[block.end[word]] > letters[block.start[word]]]

    def _spaced(self, block: Block) -> list[tuple[int, int]]:
        """Runs of two or more words of one letter or look-alike in one text: first word and end."""
        length = block.end - block.start
        single = (length == 1) & np.isin(self.kind[block.data[block.start]], [1, 2])
        for k in (2, 3):  # one letter or look-alike with punctuation around
            word = np.flatnonzero(length == k)
            own = block.data[block.start[word][:, None] + np.arange(k)]
            core = np.isin(self.kind[own], [1, 2]) & ~self.mark[own]
            single[word] = (core.sum(1) == 1) & (core | self.mark[own]).all(1)
        edge = np.zeros(len(single) + 1, bool)
        edge[block.first] = True
        begin = np.flatnonzero(single & (edge[:-1] | ~np.r_[False, single[:-1]]))
        end = np.flatnonzero(single & (edge[1:] | ~np.r_[single[1:], False])) + 1
        long = end - begin >= 2
        return list(zip(begin[long].tolist(), end[long].tolist()))

    def _restored(self, token: str) -> tuple[str, str]:
        """The words behind a token, and its letters as one word."""
        if token in self.known:
            return self.known[token]
        words = restore(token, self.model)
        both = words, restore(token.translate(NO_GAPS), self.model) if " " in words else words
        if len(token) <= CACHED:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = both
        return both

    def restored(self, block: Block) -> list[tuple[int, str]]:
        """Number of the text and the restored words, for every disguise."""
        out = []
        spans = [(w, w + 1) for w in self._signs(block).tolist()] + self._spaced(block)
        for lo, hi in spans:
            data = block.data[block.start[lo] : block.end[hi - 1]]
            token = data.tobytes().decode("utf-8", "replace").lower().strip(AROUND)
            doc = int(np.searchsorted(block.first, lo, "right")) - 1
            core = token.strip(AROUND + MARKS)
            for reading in {token, core}:  # a mark at the edge may stand for a letter
                if reading:
                    words, whole = self._restored(reading)
                    out += [(doc, w) for w in {words, whole} if w != core]
                    if hi - lo > 1:
                        out += [(doc, whole[i : i + BEGINNINGS[-1]]) for i in range(1, len(whole) - BEGINNINGS[0] + 1)]
        return out


# --- words as evidence ----------------------------------------------------------------


class Words:
    """Hashed words and beginnings of words of texts, restored ones included."""

    def __init__(self, model: np.ndarray):
        self.hasher, self.channel = WordHasher(ASCII_NOT_ALNUM, True), Channel(model)
        self.plain = WordHasher(ASCII_SPACE, False)

    def _slots(self, block: Block) -> np.ndarray:
        word = self.hasher.hashes(block)
        out = np.empty((len(BEGINNINGS) + 1, len(word)), np.int32)
        out[0] = mix(word, 11) & np.uint64(SLOTS - 1)
        length = block.end - block.start
        letter = self.hasher.letter
        for row, k in enumerate(BEGINNINGS, 1):
            at = np.minimum(block.start[:, None] + np.arange(k), max(len(block.data) - 1, 0))
            own = np.zeros(len(word), np.uint64)
            for j in range(k):
                own = own * np.uint64(0xD6E8FEB86659FD93) + letter[block.data[at[:, j]]]
            out[row] = mix(own, 100 + k) & np.uint64(SLOTS - 1)
            out[row][length < k] = out[0][length < k]  # a shorter word is its own beginning
        return out

    def blocks(self, column: pa.Array) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
        """Block, slots (features x words) and the number of the text of each word."""
        spaced = self.plain.blocks(column)
        for block, seen in zip(self.hasher.blocks(column), spaced):
            slots, doc = self._slots(block), block.doc_of_word()
            restored = self.channel.restored(seen)
            if restored:
                text_of, parts, docs = np.array([d for d, _ in restored]), [slots], [doc]
                for again in self.hasher.blocks(pa.array([w for _, w in restored], pa.large_string())):
                    parts.append(self._slots(again))
                    docs.append(text_of[again.lo : again.hi][again.doc_of_word()])
                slots, doc = np.concatenate(parts, 1), np.concatenate(docs)
            yield block, slots, doc


def _evidence(slots: np.ndarray, doc: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Per text: the strongest word, and the logarithm of one plus the sum of all."""
    word = weights[slots].max(0) if slots.size else np.zeros(0, np.float32)
    most, total = np.zeros(n), np.zeros(n)
    np.maximum.at(most, doc, word)
    np.add.at(total, doc, word)
    return np.stack([most, np.log1p(total)], 1)


def _counted(sample: DataFrame, model) -> tuple[np.ndarray, np.ndarray]:
    """Per half of the sample, class and slot, the documents with it; and documents by half and class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(model.value), np.zeros((4, SLOTS), np.uint32)
        for batch in batches:
            group = batch.column(1).to_numpy()
            for block, slots, doc in words.blocks(batch.column(0)):
                order = np.argsort(doc, kind="stable")
                slots, doc = slots[:, order], doc[order]
                bounds = np.searchsorted(doc, np.arange(block.hi - block.lo + 1))
                for i in range(block.hi - block.lo):
                    own = np.unique(slots[:, bounds[i] : bounds[i + 1]])
                    counts[group[block.lo + i], own] += 1
        for g in range(4):
            for c in range(SLOTS // CHUNK):
                part = counts[g, c * CHUNK : (c + 1) * CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g], pa.int32()), pa.array([c], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])],
                        ["g", "chunk", "counts"],
                    )

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CHUNK, np.uint32)
        for part in parts:
            for packed in part["counts"]:
                total += np.frombuffer(zlib.decompress(packed), np.uint32)
        yield pd.DataFrame({"g": [key[0]], "chunk": [key[1]], "counts": [total.tobytes()]})

    counts = np.zeros((4, SLOTS), np.uint32)
    parts = sample.select("text", "g").mapInArrow(count, "g int, chunk int, counts binary")
    for row in parts.groupBy("g", "chunk").applyInPandas(add, "g int, chunk int, counts binary").toLocalIterator():
        counts[row["g"], row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint32)
    documents = np.zeros(4)
    for row in sample.groupBy("g").count().collect():
        documents[row["g"]] = row["count"]
    return counts, documents


def _weights(other: np.ndarray, toxic: np.ndarray, others: float, toxics: float) -> np.ndarray:
    """Log-odds of the slots that clearly more toxic documents have; 0 for the rest."""
    odds = np.log((toxic + 0.5) / (toxics + 1)) - np.log((other + 0.5) / (others + 1))
    spread = np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    clear = (toxic >= LEAST_DOCUMENTS) & (odds >= LEAST_ODDS) & (odds > 2 * spread)
    return np.where(clear, odds, 0).astype(np.float32)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(beta))
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _learned(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Of rows (id, text), those of the labelled ids ``known`` (id, toxic), as text and group ``g``:
    half and class. One text an id, that with the smallest hash, and one of near copies."""
    rows = rows.join(F.broadcast(known), "id").withColumn("mark", F.xxhash64("text"))
    one = F.broadcast(rows.groupBy("id").agg(F.min("mark").alias("mark")))  # a row for each id of the sample at most
    rows = rows.join(one, ["id", "mark"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ASCII_SPACE, True)
        for batch in batches:
            for block in hasher.blocks(batch.column(0)):
                word = hasher.hashes(block)
                least = [int(windows(word[a:b], min(8, b - a)).min().view(np.int64)) if b > a else 0 for _, a, b in block.texts()]
                piece = batch.slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(least, pa.int64())], ["text", "g", "least"])

    group = F.pmod(F.xxhash64("id"), F.lit(2)) * 2 + F.when(F.col("toxic") > 0, 1).otherwise(0)
    learned = rows.select("text", group.cast("int").alias("g")).mapInArrow(copies, "text string, g int, least long")
    return learned.dropDuplicates(["least"]).drop("least")


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with ``toxicity``: held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Learns from at most ``sample`` labelled documents, those with the smallest hashes of
    their ids, and never from one whose crc32(id as text) mod 5 is 0. Near copies among
    them count once. Everything else covers all documents: the letter model and the scores.

    Ids are integers. A null or empty text has the score of no evidence. Each row is scored by itself, so
    repeated rows and ids stay; a null id is not held out. Other columns stay, a column
    named ``toxicity`` is replaced. Null labels and labels of unknown documents are not
    used; an id with several labels is toxic if one of them says so. Without labelled
    documents of both classes, the score is the share of toxic ones, or 0. An empty table
    gives an empty one.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    model = context.broadcast(letter_model(docs, text))
    id_ = F.col(key).cast("long")
    fold = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(5))

    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 0))
    known = known.groupBy(id_.alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # a bounded sample, by design
    rows = docs.select(id_.alias("id"), whole_text(text).alias("text"))

    learned = staged(_learned(rows, known), "toxicity-sample")
    counts, n = _counted(learned, model)

    halves = [_weights(counts[2 * h], counts[2 * h + 1], n[2 * h], n[2 * h + 1]) for h in (0, 1)]
    shared_halves = context.broadcast(halves)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.value)
        for batch in batches:
            group = batch.column(1).to_numpy()
            for block, slots, doc in words.blocks(batch.column(0)):
                size = block.hi - block.lo
                own = group[block.lo : block.hi]
                both = [_evidence(slots, doc, size, w) for w in shared_halves.value]
                x = np.where((own // 2 == 0)[:, None], both[1], both[0])  # from the other half
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array((own % 2).astype(float))], ["a", "b", "y"])

    fit = learned.mapInArrow(evidence, "a double, b double, y double").toPandas()  # at most ``sample`` rows
    if len(fit) and 0 < fit["y"].sum() < len(fit):
        beta = _logistic(fit[["a", "b"]].to_numpy(), fit["y"].to_numpy())
    else:
        share = float(fit["y"].mean()) if len(fit) else 0.0
        beta = np.array([0.0, 0.0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))])
    all_weights = _weights(counts[0] + counts[2], counts[1] + counts[3], n[0] + n[2], n[1] + n[3])
    shared = context.broadcast((all_weights, beta))

    kept = [c for c in docs.columns if c != "toxicity"]
    at = kept.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (weights, coefficients) = Words(model.value), shared.value
        for batch in batches:
            for block, slots, doc in words.blocks(batch.column(at)):
                x = _evidence(slots, doc, block.hi - block.lo, weights)
                p = 1 / (1 + np.exp(-np.clip(x @ coefficients[:2] + coefficients[2], -30, 30)))
                piece = batch.slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p)], [*[f"c{i}" for i in range(len(kept))], "score"])

    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    out = docs.select(*kept).mapInArrow(score, f"{fields}, score double")
    result = F.struct(
        F.coalesce(fold(F.col(f"c{kept.index(key)}")) == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], result.alias("toxicity"))


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity_scores(docs.select("doc_id", "text"), labels).select("doc_id", "toxicity.*")
