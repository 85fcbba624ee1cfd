"""Alignment of two tokenizers over a corpus, and how often their tokens meet.

Both tokenizers cut the same bytes. Where tokens of both end, a group ends; every token of
the one is linked with every token of the other in its group.

1. Each task encodes its texts and merges the ends of the tokens of all texts of a block in
   lockstep: one state array holds, for every text, the next token on either side and where
   the open group began. A step moves the side that is behind in every text at once, emits the
   groups that end there, and finished texts leave the array.
2. Spark counts, over the corpus, the documents in which each pair of ids is linked, and the
   highest count of each id of the first tokenizer.
3. Each document sums up the counts of its links. At most ``LISTED`` pairs, the most frequent
   ones, are broadcast (24 bytes each); the rest are joined by a shuffle. A pair that is not
   listed is rarer than ``LISTED`` others, so no key of that join is hot.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, small_batches, staged

FOLDER = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
LONG_SPACE = re.compile(r"\s{1000}")
LISTED = 1 << 20  # pairs that are broadcast
BLOCK_BYTES = 2 << 20  # texts merged at a time
LANE = 1024  # tokens after which a long text goes on in a row of its own
# Fixed value: how a byte-level vocabulary of this kind divides a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SMALL = 64  # links of a group that are written out one by one before equal ones are added up


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable
    Latin-1, else the next letter from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class Encoded(NamedTuple):
    """Token ids of some texts one after the other, and the first token of each and the end of the last."""

    ids: np.ndarray
    first: np.ndarray


def _encoder(file: bytes, model: dict, own: dict[int, bytes]) -> Callable[[str], list[int]]:
    """Encodes a text. A vocabulary whose ids follow its merges, with the usual division into words,
    goes to the faster of two libraries; both give the same ids."""
    before, vocab = model["pre_tokenizer"] or {}, model["model"]["vocab"]
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
    whole: list = []

    def slower(text: str) -> list[int]:
        from tokenizers import Tokenizer

        if not whole:
            whole.append(Tokenizer.from_buffer(file))
            whole[0].encode_special_tokens = True
        return whole[0].encode(text, add_special_tokens=False).ids

    ordered = [vocab[m] for m in merges] == list(range(256, 256 + len(merges))) and len(own) >= 256 + len(merges)
    usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not ordered or not usual or model["normalizer"]:
        return slower

    import tiktoken

    extra = {t["id"] for t in model["added_tokens"]}
    ranks = {token: i for i, token in own.items() if i not in extra}
    faster = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # Its search for the end of white space recurses by character.
    return lambda text: slower(text) if LONG_SPACE.search(text) else faster(text)


class Tokenizers:
    """A byte-level BPE and a piece model with the bytes of their tokens. Made anew in each task."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        letters, model = _byte_letters(), json.loads(first)
        own = {i: bytes(letters[c] for c in token) for token, i in model["model"]["vocab"].items() if all(c in letters for c in token)}
        self.encode_a = _encoder(first, model, own)
        own |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        self.a_bytes = [own.get(i, b"") for i in range(max(own) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        self.shown = [b"%d%c" % (i, sign) for sign in b",|;" for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> tuple[Encoded, Encoded]:
        """The tokens of both; none where a text is empty or not the bytes of its tokens."""
        none = np.zeros(0, np.int32)
        a, b = [none] * len(texts), [none] * len(texts)
        for i, text in enumerate(texts):
            if text:
                x, y = self.encode_a(" " + text), self.b.encode(text)
                if b"".join(map(self.a_bytes.__getitem__, x)) == b" " + text.encode() == b"".join(map(self.b_bytes.__getitem__, y)):
                    a[i], b[i] = np.array(x, np.int32), np.array(y, np.int32)
        return tuple(Encoded(np.concatenate([none, *s]), np.cumsum([0, *map(len, s)])) for s in (a, b))


def lanes(a_end: np.ndarray, a_first: np.ndarray, b_end: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a_first`` and ``b_first`` with long texts cut where tokens of both end, some ``LANE`` tokens apart."""
    a, b = [a_first], [b_first]
    for lo, hi in zip(a_first, a_first[1:]):
        at = lo + LANE
        while at < hi:
            other = int(np.searchsorted(b_end, a_end[at - 1]))
            if b_end[other] == a_end[at - 1]:
                a.append([at])
                b.append([other + 1])
                at += LANE
            else:
                at += 1
    return np.sort(np.concatenate(a)), np.sort(np.concatenate(b))


def lockstep(a_end: np.ndarray, a_first: np.ndarray, b_end: np.ndarray, b_first: np.ndarray) -> np.ndarray:
    """The groups of all texts as rows (first a, end of a, first b, end of b), in order.

    ``a_end`` and ``b_end`` are the byte ends of the tokens, counted through all texts; a text
    has the tokens from ``first[i]`` to ``first[i + 1]``, none or some on both sides."""
    p, q = a_first[:-1], b_first[:-1]
    some = p < a_first[1:]
    # next a, next b, first a of the group, first b of the group, end of the text
    state = np.stack([p, q, p, q, a_first[1:]])[:, some]
    state = state.astype(np.int32)
    cuts = [np.zeros((4, 0), np.int32)]
    while state.shape[1]:
        x, y = a_end[state[0]], b_end[state[1]]
        state[0] += x <= y
        state[1] += x >= y
        cut = np.flatnonzero(x == y)
        if len(cut):
            now = state[:, cut]
            cuts.append(now[[2, 0, 3, 1]])
            state[2:4, cut] = now[:2]
            left = state[0] < state[4]
            if not left.all():
                state = state[:, left]
    found = np.concatenate(cuts, axis=1)
    return found[:, np.argsort(found[0], kind="stable")].T


def _linked(a: Encoded, b: Encoded, groups: np.ndarray, doc: np.ndarray, n_b: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked pairs, ``doc * span + a * n_b + b`` ascending, and how often each is linked."""
    na, nb = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    links = na * nb
    one = np.flatnonzero(links <= SMALL)
    of = np.repeat(one, links[one])
    nth = np.arange(len(of)) - np.repeat(np.cumsum(links[one]) - links[one], links[one])
    x, y = a.ids[groups[of, 0] + nth // nb[of]], b.ids[groups[of, 2] + nth % nb[of]]
    keys = [doc[of] * span + x.astype(np.int64) * n_b + y]
    times = [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(links > SMALL):  # distinct ids first: a long group has few of them
        x, nx = np.unique(a.ids[groups[g, 0] : groups[g, 1]], return_counts=True)
        y, ny = np.unique(b.ids[groups[g, 2] : groups[g, 3]], return_counts=True)
        keys.append(doc[g] * span + (x.astype(np.int64)[:, None] * n_b + y).ravel())
        times.append(np.outer(nx, ny).ravel())
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(n, new) if len(new) else n


def _shown(own: Tokenizers, a: Encoded, b: Encoded, groups: np.ndarray) -> Iterator[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    signs = len(own.shown) // 3
    which = np.repeat(np.arange(len(groups)), groups[:, 1] - groups[:, 0])
    also = np.repeat(np.arange(len(groups)), groups[:, 3] - groups[:, 2])
    row = np.empty(len(a.ids) + len(b.ids), np.int64)
    x, y = a.ids.astype(np.int64), b.ids.astype(np.int64)
    x[groups[:, 1] - 1] += signs
    y[groups[:, 3] - 1] += 2 * signs
    row[np.arange(len(x)) + groups[which, 2]] = x
    row[np.arange(len(y)) + groups[also, 1]] = y
    bounds = a.first + b.first
    for lo, hi in zip(bounds, bounds[1:]):
        yield b"".join(map(own.shown.__getitem__, row[lo:hi].tolist()))[:-1]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts, the last column, have some ``BLOCK_BYTES`` together."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
        part = np.cumsum(lengths) // BLOCK_BYTES
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            held.append(batch.slice(int(at[0]), len(at)))
            size += int(lengths[at].sum())
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _read(spark, path: str) -> bytes:
    """A vocabulary file, from a local folder of the driver or from a store that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def token_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = f"{FOLDER}/{FIRST}", second: str = f"{FOLDER}/{SECOND}",
    digest: bool = False,
) -> tuple[DataFrame, int]:
    """Per row of ``docs``: ``key``, n_a, n_b, n_groups, n_links, groups, and the linked ``pairs`` of ids as
    ``a * n + b`` with the ``times`` each is linked; and n, the number of ids of the second tokenizer.

    ``first`` is a byte-level BPE that encodes a space and the text, ``second`` a piece model, which
    adds the space. The files are read once and travel with the job. ``groups`` is written as
    ``a1,a2|b1;a3|b2,b3``, with ``digest`` its lowercase hex SHA-256 (and empty without tokens).

    A text that is null or empty, or isn't the bytes of its tokens of both, has no tokens. A null
    or repeated ``key`` is a row like any other, and other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files = spark.sparkContext.broadcast((_read(spark, first), _read(spark, second)))
    sizes = Tokenizers(*files.value)
    n_a, n_b = len(sizes.a_bytes), len(sizes.b_bytes)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizers(*files.value)
        for batch in _blocks(batches):
            a, b = own.encode(batch.column(1).to_pylist())
            a_end, b_end = np.cumsum(own.a_length[a.ids]), np.cumsum(own.b_length[b.ids])
            cut_a, cut_b = lanes(a_end, a.first, b_end, b.first)
            groups = lockstep(a_end, cut_a, b_end, cut_b).astype(np.int64)
            doc = np.searchsorted(a.first, groups[:, 0], "right") - 1
            bound = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            links = np.r_[0, np.cumsum((groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2]))]
            pair, times = _linked(a, b, groups, doc, n_b, n_a * n_b)
            ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * (n_a * n_b)).astype(np.int32))
            shown = _shown(own, a, b, groups)
            shown = [hashlib.sha256(s).hexdigest() if s else "" for s in shown] if digest else [s.decode() for s in shown]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x) for x in (np.diff(a.first), np.diff(b.first), np.diff(bound), np.diff(links[bound]))],
                 pa.array(shown, pa.string()), pa.ListArray.from_arrays(ends, pa.array(pair % (n_a * n_b))),
                 pa.ListArray.from_arrays(ends, pa.array(times))],
                ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
    rows = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(align, schema)
    return rows.withColumnRenamed("id", key), n_b


def pair_counts(pairs: DataFrame, n_b: int) -> DataFrame:
    """Of rows with ``pairs``: every pair, how many rows have it, and whether no pair of its first id is in more."""
    found = staged(pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    of = F.expr(f"pair div {n_b}")
    best = found.groupBy(of.alias("a")).agg(F.max("docs").alias("most"))
    return found.withColumn("a", of).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _scored(rows: DataFrame, row: str, counts: DataFrame, listed: int) -> DataFrame:
    """``rows`` with n_best and count_sum in place of pairs and times; ``row`` numbers them."""
    level = F.floor(8 * F.log2("docs"))
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least = 0, 1 << 62  # 8 levels for each doubling of a count, so 500 rows at most
    for lev, n in levels:
        held += n
        if held > listed:
            break
        least = lev
    table = counts.where(level >= least).toArrow().sort_by("pair")
    shared = rows.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "docs", "best")])
    others = [c for c in rows.columns if c not in ("pairs", "times")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = shared.value
        for batch in batches:
            own, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            ends = own.offsets.to_numpy() - own.offsets[0].as_py()
            own = own.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            found = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            sums = []
            for value in (best, docs):
                each = np.zeros(len(own) + 1, np.int64)
                each[1:][found] = value[at[found]] * times[found]
                sums.append(pa.array(np.diff(np.cumsum(each)[ends])))
            left = pa.array(np.r_[0, np.cumsum(~found)][ends].astype(np.int32))
            rest = [pa.ListArray.from_arrays(left, pa.array(v[~found])) for v in (own, times)]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, others), *sums, *rest], [*others, "n_best", "count_sum", "pairs", "times"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    schema += ", n_best long, count_sum long, pairs array<long>, times array<long>"
    scored = rows.select(*others, "pairs", "times").mapInArrow(score, schema)
    if held <= listed:
        return scored.drop("pairs", "times")
    scored = staged(scored, "scored")
    rest = scored.select(row, F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    rest = rest.join(counts.where(level < least), "pair")
    best, docs = F.sum(F.col("times") * F.col("best").cast("long")), F.sum(F.col("times") * F.col("docs"))
    more = rest.groupBy(row).agg(best.alias("more_best"), docs.alias("more"))
    scored = scored.drop("pairs", "times").join(more, row, "left")
    for total, part in (("n_best", "more_best"), ("count_sum", "more")):
        scored = scored.withColumn(total, F.col(total) + F.coalesce(F.col(part), F.lit(0)))
    return scored


def align_tokenizers(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = f"{FOLDER}/{FIRST}", second: str = f"{FOLDER}/{SECOND}",
    digest: bool = False, listed: int = LISTED,
) -> DataFrame:
    """Per row of ``docs``: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    See ``token_groups`` for the alignment and for what has no tokens. ``count_sum`` adds, over all
    links, in how many rows their pair of ids is linked; ``n_best`` counts the links whose pair is
    in no fewer rows than any other pair of its first id. At most ``listed`` pairs are broadcast.
    An empty table gives no rows.
    """
    row = fresh("row")
    groups, n_b = token_groups(docs, key, text, first, second, digest)
    groups = staged(groups.withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = staged(pair_counts(groups, n_b), "pairs")
    out = _scored(groups, row, counts, listed)
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op13_token_alignment(docs: DataFrame) -> DataFrame:
    out = align_tokenizers(docs.select("doc_id", "text"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")
