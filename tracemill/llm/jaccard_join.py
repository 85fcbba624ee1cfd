"""Near-duplicate texts: n-gram Jaccard self-join with bitmap bounds.

A document is the set of hashes of its 4-word shingles. Documents with the same set are
one class from the start, however many they are.

* Candidates. Two sets with a Jaccard similarity of 0.85 share a shingle among the first
  15 % of each, in any order common to all. The order puts frequent shingles last, by a
  merged sketch of fixed size that counts them, so a passage that many documents share
  leads few of them to each other.
* Bounds. Each set has a bitmap in which every element flips one bit; its length follows
  the band of the set's size, and a longer one folds to a shorter. The bits in which two
  bitmaps differ are at most the elements in which the sets do, which bounds the overlap
  from above. Pairs that the sizes or the bitmaps rule out go no further.
* Exact. What is left is decided by intersecting the sorted arrays.

Sizes fall into bands of a factor of two. Sets of a band that share a shingle of their prefixes
are in the tile of the least of them; a set that may link with one of the next band is in that
too. The members of a tile are first compared with a few of its own alone, the most typical first. What is then
in one component needs no more comparing. The others meet within the tile, in blocks of
bounded size, by size and bitmap; only pairs that pass become rows. So a tile of k linked
copies costs a few times k comparisons, no two sets that share a shingle of their prefixes
and may link stay uncompared but within a component, and the components are those of all links.
Rows of shingles and tiles that very many sets share are dealt out by salt.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, heavy_keys, salted_join, small_batches, staged, whole_text
from tracemill.llm.components import connected_components
from tracemill.llm.rolling import ASCII_SPACE, Block, WordHasher, mix, signed, windows

SHINGLE = 4
SIMILAR = 85  # per cent
CELLS, CHUNK = 1 << 24, 1 << 20  # of the frequency sketch
BLOCK = 4096  # members of a tile that are compared at a time
LISTED = 1_000_000  # ids that are broadcast at most, 24 MB
# Bytes of an Arrow batch, of the texts and of the prefix sums that a worker holds at a time, and shingles
# counted at a time: beside the sketch, a worker holds little.
BATCH_BYTES, BLOCK_BYTES, CHUNK_BYTES, COUNTED = 4 << 20, 1 << 20, 1 << 18, 1 << 17


def _hasher() -> WordHasher:
    return WordHasher(ASCII_SPACE, True, BLOCK_BYTES, CHUNK_BYTES)


def _sets(block: Block, word: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    whole = windows(word, SHINGLE)
    out = []
    for _, lo, hi in block.texts():
        n = hi - lo
        if n >= SHINGLE:
            out.append(np.unique(whole[lo : hi - SHINGLE + 1]))
        else:
            out.append(windows(word[lo:hi], n) if n else np.zeros(0, np.uint64))
    return out


def _needed(n: int) -> int:
    """The least overlap that a set of n elements needs."""
    return (SIMILAR * n + 99) // 100


def _bitmap(elements: np.ndarray) -> np.ndarray:
    """Bits flipped by each element; the length is a power of two, at least four times the set's size."""
    bits = 64
    while bits < 4 * len(elements):
        bits *= 2
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed chunks of the sketch of some texts."""
    hasher, cells = _hasher(), np.zeros(CELLS, np.uint16)
    for batch in batches:
        for block in hasher.blocks(batch.column(0)):
            found = windows(hasher.hashes(block), SHINGLE)[block.window_starts(SHINGLE)]
            for lo in range(0, len(found), COUNTED):
                cell = (mix(found[lo : lo + COUNTED], 3) & np.uint64(CELLS - 1)).astype(np.int64)
                at, n = np.unique(cell, return_counts=True)
                cells[at] = np.minimum(cells[at] + n, 65535)  # a task's count stops there
    for i in range(CELLS // CHUNK):
        part = cells[i * CHUNK : (i + 1) * CHUNK]
        if part.any():
            packed = zlib.compress(part.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed])], ["chunk", "counts"])


def _frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """For each cell of the sketch, four times the binary logarithm of the shingles counted in it."""

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CHUNK, np.uint64)
        for part in parts:
            for packed in part["counts"]:
                total += np.frombuffer(zlib.decompress(packed), np.uint16)
        logs = np.minimum(4 * np.log2(total + 1), 255).astype(np.uint8)
        yield pd.DataFrame({"chunk": [key[0]], "logs": [logs.tobytes()]})

    merged = docs.select(text).mapInArrow(_counted, "chunk int, counts binary")
    merged = merged.groupBy("chunk").applyInPandas(add, "chunk int, logs binary")
    logs = np.zeros(CELLS, np.uint8)
    for row in merged.toLocalIterator():  # CELLS bytes
        logs[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["logs"], np.uint8)
    return logs


def _signatures(docs: DataFrame) -> DataFrame:
    """Per row (id, mark, text): id, mark, n, set, prefix, bitmap and how frequent its elements are;
    ``set`` identifies the set."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, "text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, logs = _hasher(), shared.value
        for batch in batches:
            for block in hasher.blocks(batch.column(2)):
                n, name, prefix, bitmap, common = [], [], [], [], []
                for elements in _sets(block, hasher.hashes(block)):
                    order = logs[(mix(elements, 3) & np.uint64(CELLS - 1)).astype(np.int64)]
                    first = len(elements) - _needed(len(elements)) + 1 if len(elements) else 0
                    # A stable sort by frequency keeps the order of the hashes below it.
                    prefix.append(signed(elements[np.argsort(order, kind="stable")[:first]]))
                    common.append(float(order.mean()) if len(order) else 0.0)
                    n.append(len(elements))
                    own = mix(elements, 5).sum(dtype=np.uint64) + np.uint64(len(elements))
                    name.append(mix(np.array([own], np.uint64)).view(np.int64)[0])
                    bitmap.append(_bitmap(elements))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(block.lo, block.hi - block.lo) for i in range(2)], pa.array(n, pa.int64()),
                     pa.array(name, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bitmap, pa.list_(pa.int64())),
                     pa.array(common, pa.float64())],
                    ["id", "mark", "n", "set", "prefix", "bitmap", "common"],
                )

    schema = "id long, mark long, n long, set long, prefix array<long>, bitmap array<long>, common double"
    return docs.mapInArrow(sign, schema)


def _members(docs: DataFrame) -> DataFrame:
    """Per row (set, text): set, and the sorted array of its elements."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for block in hasher.blocks(batch.column(1)):
                sets = [signed(s) for s in _sets(block, hasher.hashes(block))]
                own = batch.column(0).slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays([own, pa.array(sets, pa.list_(pa.int64()))], ["set", "elements"])

    return docs.mapInArrow(members, "set long, elements array<long>")


def _listed(ids: DataFrame) -> DataFrame:
    """Broadcast if there are few enough, else left to a shuffle."""
    return F.broadcast(ids) if ids.count() <= LISTED else ids


def _elements(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The elements of some sets, from the text of one document of each."""
    of = staged(sets.select("set", F.col("of.id").alias("own"), F.col("of.mark").alias("own_mark")), "wanted")
    texts = docs.join(_listed(of), F.col("id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark")))
    found = staged(_members(texts.select("set", "text")), "elements")
    if found.groupBy("set").count().where("count > 1").isEmpty():
        return found
    return staged(found.dropDuplicates(["set"]), "elements")  # rows that repeat an id and a text


def _overlaps(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, x, y) with sorted arrays x and y, those similar enough: a, b."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def _sizes_fit(x: Column, y: Column) -> Column:
    return 100 * F.least(x, y) >= SIMILAR * F.greatest(x, y)


def _pairs_of_block(own: np.ndarray, name: np.ndarray, part: np.ndarray, n: np.ndarray, bitmaps: list) -> Iterator[np.ndarray]:
    """Of the members of a block (or of two, where ``own`` differs), the pairs of different parts
    that sizes and bitmaps allow, by member: the larger names, the smaller ones."""
    order = np.argsort(n, kind="stable")
    own, name, part, n = own[order], name[order], part[order], n[order]
    bitmaps = [bitmaps[k] for k in order]
    words = np.array([len(x) for x in bitmaps])
    two = own.min() != own.max()
    for size in np.unique(words):  # ascending, as the sizes are
        lo, hi = np.searchsorted(words, [size, size], side="left")[0], np.searchsorted(words, size, side="right")
        end = np.searchsorted(words, 2 * size, side="right")  # the next band, folded to this one
        folded = np.stack([x if len(x) == size else x[:size] ^ x[size:] for x in bitmaps[lo:end]])
        for r in range(lo, hi):
            last = min(end, int(np.searchsorted(n, n[r] * 100 // SIMILAR, side="right")))
            at = np.arange(r + 1, last)
            at = at[(part[at] != part[r]) & ((own[at] != own[r]) if two else True)]
            if len(at):
                differ = np.bitwise_count(folded[at - lo] ^ folded[r - lo]).sum(1, dtype=np.int64)
                both = n[at] + n[r]
                at = at[(100 + SIMILAR) * (both - differ) >= 2 * SIMILAR * both]
                if len(at):
                    yield np.stack([np.maximum(name[at], name[r]), np.minimum(name[at], name[r])])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the blocks of rows (tile, i, j, own, set, part, n, bitmap), which lie together."""

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(found, axis=1)], ["a", "b"])

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [table.column(k).to_numpy() for k in range(3)]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        bounds = np.r_[0, np.flatnonzero(new) + 1, table.num_rows]
        own, name, part, n = (table.column(k).to_numpy() for k in range(3, 7))
        bitmap = table.column(7).combine_chunks()
        values, offsets = bitmap.values.to_numpy().view(np.uint64), bitmap.offsets.to_numpy()
        for lo, hi in zip(bounds, bounds[1:]):
            bitmaps = [values[offsets[k] : offsets[k + 1]] for k in range(lo, hi)]
            found, size = [], 0
            for of_one in _pairs_of_block(own[lo:hi], name[lo:hi], part[lo:hi], n[lo:hi], bitmaps):
                found.append(of_one)
                size += of_one.shape[1]
                if size >= 1 << 16:  # a block may have millions
                    yield rows(found)
                    found, size = [], 0
            if found:
                yield rows(found)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(3))
        keys = [batch.column(k).to_numpy() == last[k] for k in range(3)]
        begin = int(np.flatnonzero(np.all(keys, axis=0))[0])  # the last block may go on in the next batch
        if begin == 0 and held and tuple(held[0].column(k)[0].as_py() for k in range(3)) == last:
            held.append(batch)
            continue
        held.append(batch.slice(0, begin))
        yield from pairs(pa.Table.from_batches(held)) if sum(b.num_rows for b in held) else ()
        held = [batch.slice(begin)]
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _bits_fit(x: Column, y: Column, n: Column) -> Column:
    """Whether bitmaps of sets with n elements together allow enough overlap."""
    half = lambda v, m: F.zip_with(F.slice(v, F.lit(1), m), F.slice(v, m + 1, m), lambda p, q: p.bitwiseXOR(q))
    least = F.least(F.size(x), F.size(y))
    fold = lambda v: F.when(F.size(v) > least, half(v, least)).otherwise(v)
    differ = F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    # Overlap is at most (n - differ) / 2, and at least SIMILAR / (100 + SIMILAR) * n is needed.
    return (100 + SIMILAR) * (n - differ) >= 2 * SIMILAR * n


def components_of_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, mark, text): signatures, and every set ``a`` that is not the smallest of its component, ``b``."""
    signatures = staged(_signatures(docs), "signatures")
    sets = signatures.where("n > 0").groupBy("set").agg(
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap"), F.first("common").alias("common"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("of"),
    )
    sets = staged(sets, "sets")
    # A tile: sets that share a rare shingle and lie in a band of sizes; a set that may have a larger
    # partner in the next band is in that too.
    bands = F.array_distinct(F.array(_band(F.col("n")), _band(F.floor(F.col("n") * 100 / SIMILAR))))
    tokens = sets.select("set", "n", "common", F.explode("prefix").alias("shingle"), bands.alias("bands"))
    tokens = tokens.select("set", "n", "common", "shingle", F.explode("bands").alias("band"))
    tokens = tokens.withColumn("token", F.xxhash64("shingle", "band")).drop("shingle")
    least = tokens.groupBy("token").agg(F.xxhash64(F.min("set"), F.min("band")).alias("tile"), F.count("*").alias("k"))
    least = staged(least.where("k > 1"), "least")
    hot = _hot(least, "token", sets.agg(F.sum(F.size("prefix"))).first()[0] or 0)
    tiles = salted_join(tokens, least.select("token", "tile"), "token", hot).select("tile", "set", "n", "common").distinct()
    tiles = staged(tiles, "tiles")
    elements = _elements(docs, sets.join(tiles.select("set").distinct(), "set", "left_semi"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs (a, b) with sizes that fit: ruled out by their bitmaps, or intersected."""
        pairs = staged(pairs.distinct(), "met")
        x = sets.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
        y = sets.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))
        heavy = {c: heavy_keys(pairs, c) for c in "ab"}
        both = salted_join(salted_join(pairs, x, "a", heavy["a"]), y, "b", heavy["b"])
        both = both.where(_bits_fit(F.col("ba"), F.col("bb"), F.col("na") + F.col("nb"))).select("a", "b")
        both = staged(both, "pairs")
        used = both.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        of = elements.join(_listed(staged(used, "used")), "set", "left_semi")
        x = of.select(F.col("set").alias("a"), F.col("elements").alias("x"))
        y = of.select(F.col("set").alias("b"), F.col("elements").alias("y"))
        return staged(_overlaps(salted_join(salted_join(both, x, "a", heavy["a"]), y, "b", heavy["b"])), "links")

    # The most typical member of each tile, and another, meet the others.
    chosen = tiles.groupBy("tile").agg(
        F.max(F.struct("common", "set", "n")).alias("typical"), F.min(F.struct(F.xxhash64("set"), "set", "n")).alias("other"), F.count("*").alias("k")
    )
    chosen = staged(chosen, "chosen")
    hot = _hot(chosen, "tile", tiles.count())
    ones = F.array(*[F.struct(F.col(f"{c}.set").alias("one"), F.col(f"{c}.n").alias("one_n")) for c in ("typical", "other")])
    meet = salted_join(tiles, chosen.select("tile", ones.alias("ones")), "tile", hot)
    meet = meet.select("set", "n", F.inline(F.array_distinct("ones")))
    meet = meet.where((F.col("set") != F.col("one")) & _sizes_fit(F.col("n"), F.col("one_n")))
    links = linked(meet.select(F.greatest("set", "one").alias("a"), F.least("set", "one").alias("b")))

    # What lies in different components of a tile meets too: the largest part of a tile is dealt into
    # blocks, the others are copied to these and to each other's.
    parts = connected_components(links)
    members = tiles.join(parts.select(F.col("a").alias("set"), F.col("b").alias("part")), "set", "left")
    members = members.select("tile", "set", F.coalesce("part", "set").alias("part"))
    sizes = members.groupBy("tile", "part").agg(F.count("*").alias("k")).groupBy("tile").agg(
        F.count("*").alias("parts"), F.max(F.struct("k", "part")).alias("most"), F.sum("k").alias("k")
    )
    blocks = lambda k: F.greatest(F.ceil(k / BLOCK), F.lit(1)).cast("int")
    open_ = sizes.where("parts > 1").select(
        "tile", F.col("most.part").alias("main"), blocks(F.col("most.k")).alias("many"), blocks(F.col("k") - F.col("most.k")).alias("few")
    )
    members = salted_join(members, staged(open_, "open"), "tile", hot)
    main, deal = F.col("part") == F.col("main"), lambda k: F.pmod(F.xxhash64("set", F.lit(7)), k).cast("int")
    own = F.when(main, F.col("few") + deal(F.col("many"))).otherwise(deal(F.col("few")))
    met = F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many"))
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    members = members.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "part")
    members = members.join(sets.select("set", "n", "bitmap"), "set")
    blocks = members.select("tile", "i", "j", "own", "set", "part", "n", "bitmap").repartition("tile", "i", "j")
    met = blocks.sortWithinPartitions("tile", "i", "j").mapInArrow(_compared, "a long, b long")
    more = linked(met)
    if more.isEmpty():
        return signatures, parts
    return signatures, connected_components(parts.unionByName(more))


def _band(n: Column) -> Column:
    """The band of a size: sizes up to the next power of two."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) + 1e-9).cast("int")


def _hot(counted: DataFrame, key: str, total: int) -> list:
    """The keys of a table with their numbers of rows, k, that have more than a thousandth of all: less than a thousand."""
    return [row[0] for row in counted.where(F.col("k") > max(total // 1000, 256)).select(key).collect()]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, n_shingles, component_id, and whether the row ``stays``.

    Ids are integers. Two documents link if 100 * intersection >= 85 * union of their sets of distinct
    4-word shingles (words divided by ASCII white space, A-Z lower-cased; a text of fewer
    words is one shingle). ``component_id`` is the smallest id that links reach, itself
    included. ``stays`` holds for the row with that id.

    A null or empty text has no shingles, links with nothing and stays. A null id is larger
    than any other; a component without ids has a null one. Rows that repeat an id and a
    text are the same document, and all of them have the result of it. Other columns are
    not looked at. An empty table gives no rows.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.xxhash64(whole_text(text)).alias("mark"), whole_text(text).alias("text")
    )
    signatures, parts = components_of_sets(rows)
    parts = parts.select(F.col("a").alias("set"), F.col("b").alias("part"))
    own = signatures.where("n > 0").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("of"))
    own = own.join(parts, "set", "left").withColumn("part", F.coalesce("part", "set"))
    least = own.groupBy("part").agg(F.min("of").alias("least"))
    known = own.select("set", "part").join(least, "part").select("set", "least")
    found = signatures.where("n > 0").select("id", "mark", "n", "set").join(known, "set").select(
        "id", "n", F.col("least.id").alias("component"),
        (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("mark") == F.col("least.mark"))).alias("stays"), "mark",
    )
    none = signatures.where("n = 0").select("id", "n", F.col("id").alias("component"), F.lit(True).alias("stays"), "mark")
    return found.unionByName(none).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "stays", "mark"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id."""
    id_, mark, times = fresh("id"), fresh("mark"), fresh("times")
    stay = near_duplicates(docs, key, text).where("stays").groupBy(F.col(key).alias(id_), F.col("mark").alias(mark))
    stay = staged(stay.agg(F.count("*").alias(times)), "survivors")
    same = F.col(key).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(whole_text(text)) == F.col(mark))
    kept = docs.join(stay, same)
    if stay.where(F.col(times) > 1).isEmpty():
        return kept.select(*docs.columns)
    once = kept.where(F.col(times) == 1)
    repeated = kept.where(F.col(times) > 1).dropDuplicates([id_, mark])
    return once.unionByName(repeated).select(*docs.columns)


def op6_jaccard_join(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
