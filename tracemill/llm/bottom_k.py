"""Near-duplicate texts by bottom-k sketches of one hash function.

A document is the set of hashes of its 4-word shingles; its sketch has the ``K`` smallest of
them, or all if there are fewer. Documents with the same set are one class from the start.

* Inverted lists. Of each sketch the values that are rare in the corpus are listed, as many as
  leave no way to share ``SHARED`` retained values without sharing a listed one. A passage that
  many documents share is last in that order, so it fills no list.
* Estimate. The ``K`` smallest of the union of two sketches are a sample of the union of the
  sets; the share of them that both have estimates the similarity. A pair goes on if it is
  ``SHARED`` of ``K`` or more. A pair that is similar enough has 51 on average, and fewer than
  28 with a chance below 10^-9; two sets that are whole in their sketches are decided exactly.
* Exact. What is left is decided by intersecting the whole sets.

Sets of a list are in the group of the least of them. They first meet the most typical one of
the group; a group that is one component then is done. Else it is compared across: the largest
component is dealt into blocks of bounded size, the others are copied to these and meet each
other in blocks too. Overlaps within a block come from the inverted lists of its sketches. The
members of pairs that pass the estimate then meet in the same blocks with their whole sets, all
overlaps are counted at once, and what connects the members becomes rows, fewer than members. Keys with a large share of the rows are salted, and there are few enough of them to
broadcast. So a group of k linked copies costs a few times k comparisons, and no two sets that
share a listed value stay uncompared but within a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import heavy_keys, joined_by_key, key_runs, salted_join, small_batches, staged, whole_text
from tracemill.llm.components import connected_components
from tracemill.llm.rolling import ASCII_SPACE, Block, WordHasher, mix, signed, windows

SHINGLE = 4
SIMILAR = 80  # per cent
K = 64
SHARED = 28  # retained values that similar sets share at least, of K
CELLS = 1 << 20  # of the count of values
BLOCK, ELEMENTS = 2048, 1_000_000  # sets compared at a time, and their elements, with as many others
ESTIMATED = 8  # pairs a set, above which a block is compared by elements without estimating each
LISTED = 1_000_000  # ids that are broadcast at most, 24 MB


def _sets(block: Block, word: np.ndarray) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text of a block."""
    whole = windows(word, SHINGLE)
    for _, lo, hi in block.texts():
        if hi - lo >= SHINGLE:
            yield np.unique(whole[lo : hi - SHINGLE + 1])
        else:
            yield windows(word[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def _sketches(docs: DataFrame) -> DataFrame:
    """Per row (id, mark, text): id, mark, n, ``set``, which identifies the set, and its sketch, ascending without sign."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ASCII_SPACE, True)
        for batch in batches:
            for block in hasher.blocks(batch.column(2)):
                n, name, least = [], [], []
                for values in _sets(block, hasher.hashes(block)):
                    n.append(len(values))
                    own = mix(values, 5).sum(dtype=np.uint64) + np.uint64(len(values))
                    name.append(mix(np.array([own], np.uint64)).view(np.int64)[0])
                    least.append(signed(values[:K]))
                own = [batch.column(i).slice(block.lo, block.hi - block.lo) for i in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(least, pa.list_(pa.int64()))],
                    ["id", "mark", "n", "set", "sketch"],
                )

    return docs.mapInArrow(sketch, "id long, mark long, n long, set long, sketch array<long>")


def _listed_values(n: int) -> int:
    """How many values of the sketch of a set of n elements are listed."""
    kept = min(n, K)
    # A similar set of a set with up to 51 elements has 63 at most, so both are whole.
    shared = (SIMILAR * n + 99) // 100 if n * 100 <= SIMILAR * K else SHARED
    return kept - shared + 1


def _inverted(sets: DataFrame) -> DataFrame:
    """Listed values of the sets: value, set, its size, and how common the values of its sketch are."""
    cell = F.pmod(F.xxhash64("value"), F.lit(CELLS)).cast("int")
    counted = sets.select(F.explode("sketch").alias("value")).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.uint8)  # CELLS rows at most
    counts[counted.column("cell").to_numpy()] = np.minimum(8 * np.log2(counted.column("n").to_numpy()), 255)
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    cells = F.transform("sketch", lambda v: F.pmod(F.xxhash64(v), F.lit(CELLS)).cast("int"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            found, times, common = [np.zeros(0, np.int64)], [], []
            for n, values, at in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                times_of = often[at.values.to_numpy()]
                order = np.argsort(times_of, kind="stable")[: _listed_values(n)]
                found.append(values.values.to_numpy()[order])
                times.append(len(order))
                common.append(float(times_of.mean()))
            each = [np.repeat(c, times) for c in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array(common, np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *map(pa.array, each)], ["value", "set", "n", "common"])

    return sets.select("set", "n", "sketch", cells).mapInArrow(rare, "value long, set long, n long, common float")


def _passes(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the sketches of two sets, ascending without sign, allow them to be similar."""
    union = np.union1d(x, y)
    if len(x) >= K or len(y) >= K:
        union = union[:K]
    both = np.intersect1d(x, y, assume_unique=True)
    both = int(np.searchsorted(both, union[-1], "right"))
    whole = len(x) < K and len(y) < K
    return 100 * both >= SIMILAR * len(union) if whole else both >= SHARED


def _estimated(pairs: DataFrame) -> DataFrame:
    """Of rows (a, b, x, y) with sketches x and y, the pairs that pass."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _passes(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64))
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(passing, "a long, b long")


def _overlaps(values: list[np.ndarray], kind: type) -> np.ndarray:
    """For each two of some arrays of distinct values, how many they share: from inverted lists."""
    size = len(values)
    value, member = np.concatenate(values), np.repeat(np.arange(size), [len(v) for v in values])
    order = np.argsort(value, kind="stable")
    value, member = value[order], member[order]
    bounds = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True])
    found = np.zeros((size, size), kind)
    for k in np.flatnonzero(np.diff(bounds) > 1):
        own = member[bounds[k] : bounds[k + 1]]
        found[np.ix_(own, own)] += 1
    return found


def _may_link(own: np.ndarray, part: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Members of different parts (and sides, where there are two) whose sizes allow a link."""
    two = own.min() != own.max()
    fit = 100 * np.minimum(n[:, None], n) >= SIMILAR * np.maximum(n[:, None], n)
    fit &= part[:, None] != part
    return fit & (own[:, None] != own) if two else fit


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks of rows (group, i, j, own, set, part, n, sketch): the members that are in a pair that passes.
    Where more than ``ESTIMATED`` pairs a member share enough, these pass without an estimate of each."""
    for block in key_runs(batches, 3):
        own, part, n = (block.column(k).to_numpy() for k in (3, 5, 6))
        sketch = [s.values.to_numpy().view(np.uint64) for s in block.column(7)]
        whole = np.array([len(s) for s in sketch]) < K
        fit = _may_link(own, part, n)
        fit &= _overlaps(sketch, np.uint8) >= np.where(whole[:, None] & whole, 1, SHARED)
        x, y = np.nonzero(np.triu(fit))
        if len(x) <= ESTIMATED * len(sketch):
            keep = np.array([_passes(sketch[p], sketch[q]) for p, q in zip(x, y)], bool)
            x, y = x[keep], y[keep]
        yield from block.select(range(6)).take(np.unique(np.r_[x, y])).combine_chunks().to_batches()


def _linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks of rows (group, i, j, own, set, part, n, elements): pairs (a, b) that connect what the links do."""
    for block in key_runs(batches, 3):
        own, name, part, n = (block.column(k).to_numpy() for k in range(3, 7))
        both = _overlaps([s.values.to_numpy() for s in block.column(7)], np.uint32)
        link = _may_link(own, part, n) & (100 * both.astype(np.int64) >= SIMILAR * (n[:, None] + n - both))
        label, before = np.arange(len(n)), None
        while before is None or (label != before).any():
            before = label
            label = np.minimum(label, np.where(link, label, len(n)).min(axis=1))
        at = np.flatnonzero(label != np.arange(len(n)))
        x, y = name[at], name[label[at]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def _elements(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Per set of rows (set, of): set, and all its elements ascending, from the text of one document."""
    of = staged(sets.select("set", F.col("of.id").alias("own"), F.col("of.mark").alias("own_mark")), "bottom-k-wanted")
    of = F.broadcast(of) if of.count() <= LISTED else of
    texts = docs.join(of, F.col("id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark")))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ASCII_SPACE, True)
        for batch in batches:
            for block in hasher.blocks(batch.column(1)):
                found = [signed(s) for s in _sets(block, hasher.hashes(block))]
                own = batch.column(0).slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays([own, pa.array(found, pa.list_(pa.int64()))], ["set", "elements"])

    found = staged(texts.select("set", "text").mapInArrow(elements, "set long, elements array<long>"), "bottom-k-elements")
    again = found.groupBy("set").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # Rows that repeat an id and a text give a set again: the same one.
    return found if again < 2 else staged(found.dropDuplicates(["set"]), "bottom-k-elements")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b), the ones whose whole sets are similar."""
    pairs = staged(pairs.distinct(), "bottom-k-pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    elements = _elements(docs, sets.join(used, "set", "left_semi"))
    heavy = heavy_keys(pairs, "a")
    rows = joined_by_key(pairs, elements.select(F.col("set").alias("b"), F.col("elements").alias("y")), "b")
    rows = salted_join(rows, elements.select(F.col("set").alias("a"), F.col("elements").alias("x")), "a", heavy)

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                both = len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
                keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(rows.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "bottom-k-links")


def _met(meet: DataFrame, sets: DataFrame) -> DataFrame:
    """Of a table (set, one), the pairs (a, b) that pass; many sets may meet the same one."""
    x = sets.select("set", F.col("n").alias("n_x"), F.col("sketch").alias("x"))
    y = sets.select(F.col("set").alias("one"), F.col("n").alias("n_y"), F.col("sketch").alias("y"))
    both = joined_by_key(meet, y, "one").join(x, "set")
    both = both.where(100 * F.least("n_x", "n_y") >= SIMILAR * F.greatest("n_x", "n_y"))
    return _estimated(both.select(F.greatest("set", "one").alias("a"), F.least("set", "one").alias("b"), "x", "y"))


def _parted(groups: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the groups that lie in several parts (group, set, part), and of each such group
    the largest part, ``main``, with the blocks that it and the others make."""
    members = groups.join(parts.select(F.col("a").alias("set"), F.col("b").alias("part")), "set", "left")
    members = staged(members.select("group", "set", "n", F.coalesce("part", "set").alias("part")), "bottom-k-members")
    blocks = lambda x: F.greatest(F.ceil(x["k"] / BLOCK), F.ceil(x["size"] / ELEMENTS), F.lit(1)).cast("int")
    largest = members.groupBy("group", "part").agg(F.count("*").alias("k"), F.sum("n").alias("size")).groupBy("group").agg(
        F.count("*").alias("parts"), F.max(F.struct("k", "part", "size")).alias("most"), F.sum("k").alias("k"), F.sum("size").alias("size")
    )
    rest = F.struct((F.col("k") - F.col("most.k")).alias("k"), (F.col("size") - F.col("most.size")).alias("size"))
    largest = largest.where("parts > 1").select(
        "group", F.col("most.part").alias("main"), blocks(F.col("most")).alias("many"), blocks(rest).alias("few")
    )
    largest = staged(largest, "bottom-k-open")
    return joined_by_key(members.drop("n"), largest, "group"), largest


def _across(open_: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect the sets of a group that lie in different parts as all their links do."""
    # Blocks (i, j): i of the other parts, j of these from 0 on or of the largest part from ``few`` on.
    main, deal = F.col("part") == F.col("main"), lambda k: F.pmod(F.xxhash64("set", F.lit(7)), k).cast("int")
    own = F.when(main, F.col("few") + deal(F.col("many"))).otherwise(deal(F.col("few")))
    met = F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many"))
    members = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    members = members.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "part")
    members = members.join(sets.select("set", "n", "sketch"), "set")
    near = _in_blocks(members, "sketch", _compared, "group long, i int, j int, own int, `set` long, part long")
    near = staged(near, "bottom-k-near")
    elements = _elements(docs, sets.join(near.select("set").distinct(), "set", "left_semi"))
    near = near.join(elements.withColumn("n", F.size("elements").cast("long")), "set")
    return staged(_in_blocks(near, "elements", _linked_blocks, "a long, b long"), "bottom-k-links")


def _in_blocks(members: DataFrame, values: str, compare: Callable, schema: str) -> DataFrame:
    blocks = members.select("group", "i", "j", "own", "set", "part", "n", values).repartition("group", "i", "j")
    return blocks.sortWithinPartitions("group", "i", "j").mapInArrow(compare, schema)


def components_of_sketches(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, mark, text): sketches; distinct sets; and every set ``a`` that is not the smallest of its component, ``b``."""
    sketches = staged(_sketches(docs), "bottom-k-sketches")
    sets = sketches.where("n > 0").groupBy("set").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("of")
    )
    sets = staged(sets, "bottom-k-sets")
    lists = staged(_inverted(sets), "bottom-k-lists")
    least = lists.groupBy("value").agg(F.min("set").alias("group"), F.count("*").alias("k")).where("k > 1").drop("k")
    groups = joined_by_key(lists, staged(least, "bottom-k-least"), "value").select("group", "set", "n", "common").distinct()
    groups = staged(groups, "bottom-k-groups")

    # All of a group meet its most typical set.
    typical = groups.groupBy("group").agg(F.max(F.struct("common", "set")).alias("most")).select("group", F.col("most.set").alias("one"))
    meet = joined_by_key(groups, staged(typical, "bottom-k-typical"), "group").where(F.col("set") != F.col("one"))
    links = _verified(_met(staged(meet.select("set", "one").distinct(), "bottom-k-meet"), sets), sets, docs)
    parts = connected_components(links)

    # What then lies in different parts of a group is compared across these.
    open_, largest = _parted(groups, parts)
    if not largest.isEmpty():
        parts = connected_components(parts.unionByName(_across(open_, sets, docs)))
    return sketches, sets, parts


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, n_shingles, component_id, and whether the row is ``kept``.

    Ids are integers. Two documents link if 100 * intersection >= 80 * union of their sets of distinct 4-word shingles
    (words divided by ASCII white space, A-Z lower-cased; a text of fewer words is one shingle).
    ``component_id`` is the smallest id that links reach, itself included, and ``kept`` holds for the
    row that has it.

    A null or empty text has no shingles, links with nothing and is kept. A null id is larger than
    any other, and a component without ids has a null one. Rows that repeat an id and a text are one
    document and have its result; of rows with one id and different texts in one component, the one
    with the smallest hash of its text is kept. Other columns are not looked at. An empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(whole_text(text)).alias("mark"), whole_text(text).alias("text"))
    sketches, sets, parts = components_of_sketches(rows.withColumn("id", F.col("id").cast("long")))
    own = sets.select("set", "of").join(parts.select(F.col("a").alias("set"), F.col("b").alias("part")), "set", "left")
    own = own.withColumn("part", F.coalesce("part", "set"))
    least = own.groupBy("part").agg(F.min("of").alias("least"))
    own = staged(own.select("set", "part").join(least, "part").select("set", "least"), "bottom-k-own")
    found = joined_by_key(sketches.where("n > 0").select("id", "mark", "n", "set"), own, "set")
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("mark") == F.col("least.mark"))
    found = found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), first.alias("kept"))
    none = sketches.where("n = 0").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(none)


def op12_minhash_dedup(docs: DataFrame) -> DataFrame:
    out = near_copies(docs.select("doc_id", "text"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
