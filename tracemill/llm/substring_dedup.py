"""Removal of repeated passages by a count-min prefilter and exact grouping.

1. Every task hashes the windows of its texts into a count-min sketch of ``DEPTH`` rows
   whose counters stop at two, and sends the touched cells as compressed gaps. The
   sketches of all tasks merge by ranges of cells, each in its own group.
2. A second pass keeps the windows whose estimate is two or more. The sketch never
   estimates too low, so no repeated window is lost. Of the kept windows, each task
   sends the earliest place of each, found by parts of the hash; the grouping by 96-bit
   window hash finds the earliest place of all. Rows are sorted behind that exchange only;
   in front of it there is next to nothing left to merge.
3. A third pass removes the words of every estimated window that is not at the earliest
   place of its word sequence: those estimated too high are their own earliest place.

Nothing here grows with the number of copies: a window is one row per task at most, and
the group of a window keeps one place. The sketch has at least three cells a window up to
``MAX_CELLS`` a row, which bounds the broadcast at DEPTH * MAX_CELLS / 8 bytes (128 MB), less by compression.
Beyond about 180 million windows more windows pass the filter and are grouped; the result
is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import small_batches, staged
from tracemill.llm.rolling import ASCII_SPACE, OTHER_STEP, Block, WordHasher, mix, signed, windows

WINDOW = 20
DEPTH = 2
CHUNK = 1 << 20  # cells merged in one group
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 29
FLUSH = 4 << 20  # windows a task holds before it sends their cells (8 bytes each); half as many places
PARTS = 16  # of the hash, by which a task sorts the places it holds
# Bytes of an Arrow batch, of the texts and of the prefix sums that a worker holds at a time.
BATCH_BYTES, BLOCK_BYTES, CHUNK_BYTES = 4 << 20, 1 << 20, 1 << 18


def _hasher() -> WordHasher:
    return WordHasher(ASCII_SPACE, False, BLOCK_BYTES, CHUNK_BYTES)


def _cells(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes, row + 1) & np.uint64(cells - 1)).astype(np.int64)


def _pack(places: np.ndarray) -> bytes:
    """Ascending numbers as compressed gaps: a byte each, after a 255 for every 255 in it."""
    gap = np.diff(places, prepend=0)
    coded = np.full(int((gap // 255).sum()) + len(gap), 255, np.uint8)
    coded[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return zlib.compress(coded.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    coded = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.cumsum(coded, dtype=np.int64)[coded < 255]


def _pieces(touched: np.ndarray, cells: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """The sketch of some windows, of whose cells ``touched`` has a row each, and is sorted:
    touched cells, and cells touched twice, by range."""
    bounds = np.arange(0, cells + 1, CHUNK, dtype=np.uint32)  # as the cells are, which else would be copied
    for row, cell in enumerate(touched):
        cell.sort()
        at = np.searchsorted(cell, bounds)
        for i in np.flatnonzero(at[:-1] < at[1:]).tolist():
            part = cell[at[i] : at[i + 1]] - bounds[i]
            new = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=new[1:])
            yield row, i, _pack(part[new]), _pack(np.unique(part[~new]))


def _merge(key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    once, twice = np.zeros(CHUNK, bool), np.zeros(CHUNK, bool)
    for piece in pieces:
        for touched, again in zip(piece["touched"], piece["again"]):
            cell = _unpack(touched)
            twice[cell[once[cell]]] = True
            once[cell] = True
            twice[_unpack(again)] = True
    bits = zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)
    yield pd.DataFrame({"row": [key[0]], "chunk": [key[1]], "bits": [bits]})


class Sketch:
    """The cells counted twice or more, as one bit each; ``chunks`` has them packed by row and range.

    It is pickled packed, so a worker unpacks it once and then holds nothing but the bits."""

    def __init__(self, chunks: Iterable[tuple[int, int, bytes]], cells: int):
        self.bits, self.cells = np.zeros((DEPTH, cells // 8), np.uint8), cells
        for row, chunk, packed in chunks:
            at = chunk * CHUNK // 8
            self.bits[row, at : at + CHUNK // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)

    def __reduce__(self):
        chunks = [
            (row, i, zlib.compress(self.bits[row, i * CHUNK // 8 : (i + 1) * CHUNK // 8].tobytes(), 1))
            for row in range(DEPTH)
            for i in range(self.cells // CHUNK)
        ]
        return Sketch, (chunks, self.cells)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(DEPTH):
            at = np.flatnonzero(out)
            cell = _cells(hashes[at], row, self.cells)
            out[at] = (self.bits[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
        return out


def _sketch(docs: DataFrame, text: str, window: int) -> Sketch:
    """The merged sketch."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cells = MIN_CELLS
    while cells < size // 2 and cells < MAX_CELLS:  # a word and its space are six bytes or so
        cells *= 2

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = _hasher(), np.empty((DEPTH, FLUSH), np.uint32), 0

        def flush():
            for rows in batched(_pieces(held[:, :n], cells), 64):
                part = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2]), pa.array(part[3])],
                    ["row", "chunk", "touched", "again"],
                )

        for batch in batches:
            for block in hasher.blocks(batch.column(0)):
                found = windows(hasher.hashes(block), window)[block.window_starts(window)]
                while len(found):  # those of a very long text may be more than are held
                    part, found = found[: FLUSH - n], found[FLUSH - n :]
                    for row in range(DEPTH):
                        held[row, n : n + len(part)] = _cells(part, row, cells)
                    n += len(part)
                    if n == FLUSH:
                        yield from flush()
                        n = 0
        yield from flush()

    merged = (
        docs.select(text)
        .mapInArrow(sketch, "row int, chunk int, touched binary, again binary")
        .groupBy("row", "chunk")
        .applyInPandas(_merge, "row int, chunk int, bits binary")
    )
    # DEPTH * MAX_CELLS / 8 bytes at most; they come packed, one after the other.
    return Sketch(((row["row"], row["chunk"], row["bits"]) for row in merged.toLocalIterator()), cells)


def _estimated(block: Block, hashes: np.ndarray, sketch: Sketch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows estimated to repeat, and the hashes of all windows."""
    found = windows(hashes, window)
    starts = block.window_starts(window)
    return starts[sketch.repeated(found[starts])], found


def _placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that order its documents and tell them apart, and their names.

    The id alone if all have one and no two texts share it; a hash of the text and the
    number of a row without an id are there only if needed, so they cost the shuffle nothing."""
    hashed = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    texts = docs.groupBy("id").agg(F.min(hashed).alias("least"), F.max(hashed).alias("most"))
    without = F.col("id").isNull()
    found = texts.agg(F.max(without), F.max(~without & (F.col("least") != F.col("most")))).first()
    last = F.lit((1 << 63) - 1)
    if not found[0] and not found[1]:
        return docs.withColumn("place", F.col("id")), ["place"]
    key = F.lit(-1).cast("long") - hashed  # below zero, so before rows without an id
    rows = docs.where(~without).withColumn("place", F.col("id")).withColumn("key", key)
    if not found[0]:
        return rows, ["place", "key"]
    others = staged(docs.where(without).withColumn("nth", F.monotonically_increasing_id()), "substring-no-id")
    others = others.select("id", "text", last.alias("place"), hashed.alias("key"), "nth")
    return rows.withColumn("nth", F.lit(0).cast("long")).unionByName(others), ["place", "key", "nth"]


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: its ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` text.

    A word is removed if a window of ``window`` consecutive words that covers it has the
    same words as a window that starts earlier, in a smaller id or earlier in the same
    document. ``kept`` has the other words, joined by one space.

    Ids are integers. A null or empty text has no words. Rows with equal ids and texts count as one document
    and both stay; those with one id and different texts are documents in the order of a
    hash of the text. Rows without an id come after all others, each a document of its own,
    also in the order of a hash, so of equal ones one stays. They are written to the shared
    folder, where each has a number that both passes read. Other columns are not looked at.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    rows, at = _placed(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(rows, "text", window))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch, held, n = _hasher(), shared.value, [], 0

        def flush():
            for k in range(PARTS):
                part = [np.flatnonzero(piece[0] % np.uint64(PARTS) == k) for piece in held]
                a, b, *doc, pos = (np.concatenate([x[own] for x, own in zip(column, part)]) for column in zip(*held))
                order = np.lexsort((pos, *doc[::-1], b, a))
                first = np.ones(len(a), bool)
                first[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
                first = order[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[first]) for x in (signed(a), b, *doc, pos)], ["a", "b", *at, "pos"]
                )

        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, len(at) + 1)]
            for block in hasher.blocks(batch.column(0)):
                word = hasher.hashes(block)
                own, found = _estimated(block, word, sketch, window)
                if not len(own):
                    continue
                other = windows(word, window, OTHER_STEP)[own].astype(np.uint32).view(np.int32)
                doc = np.searchsorted(block.first, own, "right") - 1
                held.append((found[own], other, *[x[block.lo + doc] for x in ids], (own - block.first[doc]).astype(np.int32)))
                n += len(own)
                if n >= FLUSH // 2:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    earliest = (
        rows.select("text", *at)
        .mapInArrow(places, f"a long, b int, {', '.join(f'{c} long' for c in at)}, pos int")
        .repartition("a", "b")
        .groupBy("a", "b")
        .agg(F.min(F.struct(*at, "pos")).alias("at"))
        .groupBy(*[F.col(f"at.{c}").alias(c) for c in at])
        .agg(F.collect_list("at.pos").alias("earliest"))
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = _hasher(), shared.value
        for batch in batches:
            ids, stay = batch.column(0), batch.column(2)
            for block in hasher.blocks(batch.column(1)):
                at, _ = _estimated(block, hasher.hashes(block), sketch, window)
                cover = np.zeros(len(block.start) + 1, np.int32)
                bounds = np.searchsorted(at, block.first)
                n_words, n_removed, kept = [], [], []
                for k, (i, lo, hi) in enumerate(block.texts()):
                    own = at[bounds[k] : bounds[k + 1]]
                    if len(own) and stay[i].is_valid:
                        own = own[~np.isin(own - lo, stay[i].values.to_numpy())]
                    np.add.at(cover, own, 1)
                    np.add.at(cover, own + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                data = block.data.tobytes()
                for _, lo, hi in block.texts():
                    out = gone[lo:hi]
                    left = np.flatnonzero(~out) + lo
                    n_words.append(hi - lo)
                    n_removed.append(int(out.sum()))
                    kept.append(b" ".join([data[s:e] for s, e in zip(block.start[left].tolist(), block.end[left].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.lo, block.hi - block.lo), pa.array(n_words, pa.int64()),
                     pa.array(n_removed, pa.int64()), pa.array(kept).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return rows.join(earliest, at, "left").select("id", "text", "earliest").mapInArrow(
        keep, "doc_id long, n_words long, n_removed long, kept string"
    )


def op10_substring_dedup(docs: DataFrame) -> DataFrame:
    out = repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
