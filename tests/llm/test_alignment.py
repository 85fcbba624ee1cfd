"""The two tokenizers' alignment against plain Python, pair by pair."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import brute
from tracemill.llm.token_alignment import align_tokenizers, op13_token_alignment

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def result(df, last="groups_sha256"):
    rows = df.collect()
    out = {r["doc_id"]: tuple(r[n] for n in [*NAMES, last]) for r in rows}
    assert len(out) == len(rows)
    return out


def special():
    return [
        "<s> </s> <unk> <|endoftext|> <0x41> <|startoftext|>", "a\x00b", "▁x ▁▁", " lead", "trail ", "tab\there\n\n\nlines\r\n",
        " " * 1001, "x" + " " * 1_000_000, "\n" * 777 + "x", "ab" * 3000, "日本語のテキスト、 and 한국어 😀👩‍👩‍👧", "ﬁ ½ é ​﻿", "x", " ",
        "0123456789" * 30, "ـ" * 200 + "!" * 200, "\x7f\x01 \x85",
    ]


def test_made_texts(documents, rows):
    own = rows + [(1000 + i, t) for i, t in enumerate(special())]
    assert result(op13_token_alignment(documents(own))) == brute.alignment(own)


def test_given_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(op13_token_alignment(docs)) == brute.alignment(own)


@pytest.mark.parametrize("listed", [0, 40])
def test_few_pairs_broadcast(documents, rows, listed):
    own = rows[:20] + [(1000 + i, t) for i, t in enumerate(special())]
    assert result(align_tokenizers(documents(own), digest=True, listed=listed), "groups") == brute.alignment(own)


def test_groups_spell_the_text(documents):
    found = align_tokenizers(documents([(1, "two words"), (2, None)])).collect()
    by_id = {r["doc_id"]: r["groups"] for r in found}
    assert by_id[2] == "" and len(by_id[1].split(";")) == {r["doc_id"]: r["n_groups"] for r in found}[1] > 0


def test_odd_rows(spark):
    """Null and repeated ids are rows of their own; clashing names, no rows."""
    own = [(None, "same text here"), (None, "same text here"), (3, "same text here"), (3, "other"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in own], "doc_id long, text string, pairs string, n_best int")
    found = sorted(((r["doc_id"] or -1, r["n_a"], r["count_sum"], r["n_links"]) for r in align_tokenizers(docs).collect()))
    assert [f[0] for f in found] == [-1, -1, 3, 3, 4, 4]
    assert found[0][2] == found[0][3] * 3 and found[-1][1:] == (0, 0, 0)
    assert align_tokenizers(docs.where(F.lit(False))).collect() == []


def test_both_encoders_agree():
    """The faster library gives the ids of the other for letters, digits, marks and spaces of all kinds."""
    from tokenizers import Tokenizer

    from tracemill.llm import token_alignment as own

    with open(f"{own.FOLDER}/{own.FIRST}", "rb") as first, open(f"{own.FOLDER}/{own.SECOND}", "rb") as second:
        files = first.read(), second.read()
    faster, slower = own.Tokenizers(*files).encode_a, Tokenizer.from_buffer(files[0])
    assert "slower" not in faster.__qualname__
    slower.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 101 == 0)]
    for c in points:
        text = f" a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}  {chr(c)}"
        assert faster(text) == slower.encode(text, add_special_tokens=False).ids, hex(c)


def test_long_texts_in_lanes(documents, monkeypatch):
    from tracemill.llm import token_alignment as own

    rows = [(i, " ".join(f"w{j * 7 % 1013} é日" for j in range(n))) for i, n in enumerate([0, 3, 900, 40, 0, 2500])]
    monkeypatch.setattr(own, "LANE", 50)
    assert result(op13_token_alignment(documents(rows))) == brute.alignment(rows)
