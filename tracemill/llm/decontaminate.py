"""Benchmark decontamination by a Wu-Manber search over words.

Patterns are windows of 13 consecutive item words. Pattern words are hashed, and blocks of
two adjacent words index the tables: SHIFT says how far the next possible end of a pattern
is when a block ends here, and a block with shift zero leads to a bucket of patterns with
that last block, in which the block at the start must agree before all words are compared.

The search visits many places at once: texts are cut into stretches that overlap by a
pattern less a word, a cursor runs over each, and all cursors of a block of texts move in
one array operation, each by its own shift.

Patterns are taken in blocks of at most ``max_patterns`` and ``max_bytes``, one search after
the other, so what is broadcast and held at once is bounded, whatever the size of the
benchmark; every block sees every text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import NOT_WORD, fresh, small_batches, staged, words
from tracemill.llm.rolling import ASCII_NOT_ALNUM, Block, WordHasher, mix

WINDOW = 13
MAX_PATTERNS, MAX_BYTES = 500_000, 64 << 20  # of a block: some 200 MB in a worker
SLOTS = 1 << 20  # of the shift table
STRETCH = 256  # words a cursor runs over
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _blocks(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each word; the first may have none."""
    if size == 1:
        return mix(word, 7)
    out = np.zeros(len(word), np.uint64)
    out[1:] = mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:], 7)
    return out


class Patterns:
    """Shift table and buckets for patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, list], hasher: WordHasher):
        self.length, self.size = length, min(2, length)
        self.most = length - self.size + 1
        self.shift = np.full(SLOTS, self.most, np.uint8)
        texts = list(patterns)
        column = pa.array([t.decode() for t in texts], pa.large_string())
        parts = []
        for block in hasher.blocks(column):
            ends = _blocks(hasher.hashes(block), self.size)
            parts.append(ends.reshape(-1, length))
        ends = np.concatenate(parts)
        for j in range(self.size - 1, length):
            np.minimum.at(self.shift, (ends[:, j] & np.uint64(SLOTS - 1)).astype(np.int64), length - 1 - j)
        order = np.argsort(ends[:, -1], kind="stable")
        self.last, self.head = ends[order, -1], ends[order, self.size - 1]
        self.texts, self.items = [texts[i] for i in order], [patterns[texts[i]] for i in order]

    def search(self, block: Block, word: np.ndarray, data: bytes) -> list[tuple[int, list]]:
        """First word and items of every occurrence in the block of texts."""
        at = _blocks(word, self.size)
        slot = (at & np.uint64(SLOTS - 1)).astype(np.int64)
        stop, cursor = [], []
        for _, lo, hi in block.texts():  # the places where a pattern can end, in stretches
            begin = np.arange(lo + self.length - 1, hi, STRETCH)
            cursor.append(begin)
            stop.append(np.minimum(begin + STRETCH, hi))
        cursor, stop = np.concatenate(cursor), np.concatenate(stop)
        hits = []
        while len(cursor):
            step = self.shift[slot[cursor]]
            hits.append(cursor[step == 0])
            cursor = cursor + np.maximum(step, 1)
            going = cursor < stop
            cursor, stop = cursor[going], stop[going]
        ends = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.last, at[ends]), np.searchsorted(self.last, at[ends], "right")
        found = []
        for end, a, b in zip(*(x[lo < hi].tolist() for x in (ends, lo, hi))):
            first = end - self.length + 1
            same = np.flatnonzero(self.head[a:b] == at[first + self.size - 1])
            if len(same):
                own = b" ".join([data[block.start[w] : block.end[w]] for w in range(first, end + 1)]).lower()
                found += [(first, self.items[a + i]) for i in same.tolist() if self.texts[a + i] == own]
        return found


def _windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (words, item) of the windows of all items."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    items = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), words(lowered, NOT_WORD).alias("w")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return (
        items.where(F.size("w") > 0)
        .select("item", "w", F.explode(starts).alias("at"))
        .select(F.array_join(F.expr(f"slice(w, at, {window})"), " ").alias("words"), "item")
        .distinct()
    )


def _searched(docs: DataFrame, patterns: list, kept: list[str], text: str, every: bool) -> DataFrame:
    """Columns ``kept`` of ``docs`` with cover (flat starts and ends), items and n_words, from one block of patterns;
    with ``every``, also rows without an occurrence."""
    by_length: dict[int, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
    for row in patterns:
        by_length[row["words"].count(" ") + 1][row["words"].encode()].append(row["item"])
    shared = docs.sparkSession.sparkContext.broadcast({k: dict(v) for k, v in by_length.items()})
    own_text, names = kept.index(text), [f"c{i}" for i in range(len(kept))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ASCII_NOT_ALNUM, True)
        tables = [Patterns(length, p, hasher) for length, p in shared.value.items()]
        for batch in batches:
            for block in hasher.blocks(batch.column(own_text)):
                word, data = hasher.hashes(block), block.data.tobytes()
                cover = [[] for _ in range(block.hi - block.lo)]
                item = [set() for _ in cover]
                for t in tables:
                    for first, ids in t.search(block, word, data):
                        doc = int(np.searchsorted(block.first, first, "right")) - 1
                        at = first - int(block.first[doc])
                        cover[doc].append((at, at + t.length))
                        item[doc].update(ids)
                piece = batch.slice(block.lo, block.hi - block.lo)
                out = pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array([_merged(c) for c in cover], pa.list_(pa.int32())),
                     pa.array([sorted(i) for i in item], pa.list_(pa.string())), pa.array(block.counts, pa.int64())],
                    [*names, "cover", "items", "n_words"],
                )
                yield out if every else out.filter(pa.array([bool(c) for c in cover], pa.bool_()))

    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    return docs.select(*kept).mapInArrow(search, f"{fields}, cover array<int>, items array<string>, n_words long")


def _merge_covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        covers = [_merged([s for c in found for s in zip(c[::2], c[1::2])]) for found in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(covers, pa.list_(pa.int32())), batch.column(2)], ["row", "cover", "items"])


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_patterns: int = MAX_PATTERNS, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``docs`` with ``hits``: n_words, n_hit, items (ids as sorted strings) and contaminated.

    A document word is hit if it lies in an occurrence of a window, ``window`` consecutive
    words of an item; an item of fewer words is one window. Contaminated: 5 % of the words
    or more are hit, and at least one.

    Each row is judged by itself, so repeated rows and ids stay; its columns stay as they
    are, a column named ``hits`` is replaced. A null or empty text has no words. Items
    without an id or words are no items; items with one id count as one. Either table may
    be empty. With several blocks of patterns, the texts are written once with a number for
    each row, and each block's occurrences before the next block is searched for.
    """
    small_batches(docs.sparkSession)
    patterns = staged(_windows(benchmark, item_id, item_text, window), "benchmark-windows")
    size = patterns.agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // max_patterns), -(-(size["bytes"] or 0) // max_bytes))
    # By words and item, so that words of very many items are dealt out too.
    of = F.pmod(F.xxhash64("words", "item"), F.lit(parts))
    kept = [c for c in docs.columns if c != "hits"]
    if parts == 1:
        out = _searched(docs, patterns.collect(), kept, text, every=True)
        out = out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.struct("cover", "items", "n_words").alias("hits"))
    else:
        row = fresh("row")
        given = staged(docs.select(*kept, F.monotonically_increasing_id().alias(row)), "benchmark-texts")
        found = None
        for part in range(parts):
            block = _searched(given, patterns.where(of == part).collect(), [row, text], text, every=False)
            block = staged(block.select(F.col("c0").alias("row"), "cover", "items"), "benchmark-hits")
            found = block if found is None else found.unionByName(block)
        names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
        found = found.groupBy("row").agg(F.collect_list("cover").alias("covers"), names.alias("items"))
        found = found.mapInArrow(_merge_covers, "row long, cover array<int>, items array<string>").withColumnRenamed("row", row)
        lowered = words(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD)
        none = F.array().cast("array<int>"), F.array().cast("array<string>")
        cover, items = fresh("cover"), fresh("items")
        found = found.select(row, F.col("cover").alias(cover), F.col("items").alias(items))
        hits = F.struct(
            F.coalesce(cover, none[0]).alias("cover"), F.coalesce(items, none[1]).alias("items"), F.size(lowered).cast("long").alias("n_words")
        )
        out = given.join(found, row, "left").select(*kept, hits.alias("hits"))
    ends, n_words = F.col("hits.cover"), F.col("hits.n_words")
    pairs = F.sequence(F.lit(0), F.size(ends) - 2, F.lit(2))
    n_hit = F.when(F.size(ends) > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda s, i: s + F.get(ends, i + 1) - F.get(ends, i)))
    n_hit = F.coalesce(n_hit, F.lit(0).cast("long"))
    hits = F.struct(
        n_words.alias("n_words"), n_hit.alias("n_hit"), F.col("hits.items").alias("items"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )
    return out.select(*kept, hits.alias("hits"))


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """The union of the spans as flat starts and ends."""
    out: list[int] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def op2_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = benchmark_hits(docs.select("doc_id", "text"), benchmark)
    return hits.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), "hits.contaminated",
    )
