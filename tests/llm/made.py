"""Made documents: null, empty, short, long, copied, nearly copied and repetitive texts."""

from __future__ import annotations

import random

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "the of and ka lo mi re su ta no ve zi".split() for b in ["", "n", "rth", "ly", "é", "ing"]]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "  ", ". ", "\n", "\t"]) for w in words)


def made_documents() -> list[tuple[int, str | None]]:
    """Null, empty, blank, short, very long, copied, nearly copied and repetitive texts."""
    rng = random.Random(7)
    texts: list[str | None] = [None, "", " \n\t", "one", "two words", "three Words here", "ÉÀ é à", "a\x1cb\x85c\xa0d e"]
    texts += [prose(rng, rng.randint(20, 200)) for _ in range(30)]
    long = prose(rng, 30_000)
    texts += [long, long]
    base = prose(rng, 120)
    words = base.split(" ")
    texts += [base] * 4 + [base.upper().replace("É", "é")]
    for i in range(12):  # near copies, some below the limit
        own = list(words)
        for _ in range(i):
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    shared = prose(rng, 60)
    texts += [prose(rng, 40) + shared + prose(rng, 30) for _ in range(8)]
    line = prose(rng, 12).replace("\n", " ")
    texts += ["\n".join([line] * 6), " ".join(["again"] * 300), " ".join(["a b c d e f g h i"] * 5)]
    return list(enumerate(texts))
