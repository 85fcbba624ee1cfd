"""License labels and spans against diagonal voting in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

import brute
from made import prose
from tracemill.llm.license_scan import ENOUGH, NEAR, license_spans
from tracemill.llm.license_texts import BASE_PHRASES, NOTICES, PHRASES


def plain(text: str, more=()) -> tuple[set, float]:
    """Spans (first, end, label) and the best share."""
    words, spans, best = brute.ALNUM.findall(text.translate(brute.LOWER)), set(), 0.0
    pack = [(label, t, 2) for label, t in [*BASE_PHRASES, *PHRASES]]
    pack += [(label, t, 4) for label, t in [*NOTICES, *((x, " ".join(brute.ALNUM.findall(t.lower()))) for x, t in more)]]
    for label, template, width in pack:
        own = template.split()
        runs, at = len(own) - width + 1, defaultdict(list)
        for k in range(runs):
            at[tuple(own[k : k + width])].append(k)
        diagonals = defaultdict(list)
        for p in range(len(words) - width + 1):
            for t in at.get(tuple(words[p : p + width]), ()):
                diagonals[p - t].append((p, t))
        last, group = None, []
        for d in [*sorted(diagonals), None]:
            if group and (d is None or d - last > (NEAR if width == 4 else 0)):
                share = len({t for _, t in group}) / runs
                best = max(best, share)
                if share >= (ENOUGH if width == 4 else 1):
                    spans.add((min(p for p, _ in group), max(p for p, _ in group) + width, label))
                group = []
            if d is not None:
                group += diagonals[d]
                last = d
    return spans, best


def changed(rng: random.Random, text: str, n: int) -> str:
    words = text.split()
    for _ in range(n):
        k = rng.randrange(len(words))
        how = rng.random()
        words[k : k + 1] = ["other"] if how < 0.6 else [words[k], "more"] if how < 0.8 else []
    return " ".join(words)


def check(spark, texts, more=(), **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in license_spans(df, more=more, **how).collect()}
    for i, text in enumerate(texts):
        spans, best = plain(text or "", more)
        assert {(s["first"], s["end"], s["label"]) for s in found[i]["spans"]} == spans
        assert found[i]["labels"] == sorted({s[2] for s in spans})
        assert abs(found[i]["score"] - best) < 1e-9
    return found


def test_pack_against_plain(spark):
    rng = random.Random(9)
    texts = [None, "", "MIT License, see the GNU Lesser General Public License"]
    for label, notice in NOTICES:
        for n in (0, 2, 8):
            texts.append(f"{prose(rng, 20)} {changed(rng, notice, n)}\n{prose(rng, 20)}")
    texts += [" ".join(n for _, n in rng.sample(NOTICES, 4)) for _ in range(5)]
    check(spark, texts)


@pytest.mark.parametrize("listed", [100_000, 10])
def test_long_templates(spark, listed):
    """A license of 1,500 words with ten changes, in templates of the caller's; broadcast or joined by a shuffle."""
    rng = random.Random(10)
    license_ = prose(rng, 1500)
    more = [("own", license_), ("own-2", prose(rng, 300)), ("own", "just four words here")]
    texts = [f"{prose(rng, 30)} {changed(rng, license_, 10)} {prose(rng, 30)}", changed(rng, license_, 700), license_ * 2, prose(rng, 2000),
             "Just FOUR words, here", None, "of the " * 3000]
    found = check(spark, texts, more, listed=listed)
    assert found[0]["labels"] == ["own"] and found[0]["spans"][0]["share"] > 0.95
    assert len(found) == len(texts)


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError, match="4 words"):
        license_spans(spark.createDataFrame([(1, "x")], "doc_id long, text string"), more=[("own", "a b c")])
