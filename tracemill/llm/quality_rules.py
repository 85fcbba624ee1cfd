"""Quality rules: repetition and length, and divergence from the language.

A document's characters by class, and its words by common word of a language, are two
histograms. Each is compared by Jensen-Shannon distance (base 2, 0 to 1) with those of all
documents of each language, and the nearest counts, so a label of another language listed
does no harm.
Short documents are not judged by a histogram that they can't fill. Languages without a
word list share one reference and have no word histogram, so there are at most
``len(COMMON) + 1`` references, and their documents are not judged by words.

The limit of words is the language's own: the distance of a text that has its common words
``LEAST_COMMON`` times as often, so it grows with the share of these words in the language.

All is one projection of built-in functions over the text, after an aggregate that finds
the references; no row is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import SPACE, let, whole_text

# Frequent function words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "on", "as", "at", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "ein", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su"],
}
SYMBOLS = r"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
REPEAT = 8  # words in a window
GUARD_WORDS, GUARD_CHARS = 100, 300
MAX_CHARACTER_DISTANCE = 0.30
LEAST_COMMON = 0.05  # of the share of common words that a language has


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def pairwise(array: Column, distance: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each element and the one ``distance`` later."""

    def pairs(a: Column) -> Column:
        n = F.greatest(F.size(a) - F.lit(distance), F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + distance), n), f)

    return let(array, pairs)


def window_hashes(hashes: Column, width: int) -> Column:
    """Hashes of ``width`` consecutive elements (a power of two), by doubling."""
    done = 1
    while done < width:
        hashes = pairwise(hashes, done, lambda a, b: F.xxhash64(a, b))
        done *= 2
    return hashes


def _known(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON)), lang).otherwise(F.lit("other"))


def _histograms(t: Column, w: Column) -> Column:
    """Of a text and its words: characters by class, and the common words of any language in it."""
    inside = F.length(F.array_join(w, "")).cast("long")
    counted = F.struct(
        inside.alias("inside"), (F.length(t) - inside).alias("space"),
        _length_without(t, r"[^\p{L}\p{M}]+").alias("letters"), _length_without(t, r"[^\p{Lu}]+").alias("upper"),
        _length_without(t, r"[^0-9]+").alias("digits"), _length_without(t, f"[^{SYMBOLS}]+").alias("symbols"),
    )

    def characters(c: Column) -> Column:
        rest = c["inside"] - c["letters"] - c["digits"] - c["symbols"]
        return F.array(c["letters"] - c["upper"], c["upper"], c["digits"], c["symbols"], c["space"], rest)

    common = sorted({c for own in COMMON.values() for c in own})
    used = F.filter(F.transform(w, F.lower), lambda x: x.isin(common))
    return let(
        counted,
        lambda c: F.struct(
            c["inside"].alias("inside"), c["symbols"].alias("symbols"), characters(c).alias("characters"),
            F.size(w).alias("words"), used.alias("used"),
        ),
    )


def _vocabulary(h: Column, lang: str) -> Column:
    """Counts of the common words of a language, and of all other words."""
    counts = [F.size(F.filter(h["used"], lambda x: x == c)).cast("long") for c in COMMON[lang]]
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return let(F.array(*counts), lambda a: F.concat(a, F.array(h["words"] - total(a))))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts to one of shares; null if either is empty."""

    def term(x: Column, y: Column) -> Column:
        half = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / half)).otherwise(0.0)
        return part(x) + part(y)

    def distance(total: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: term(x / total, y))
        divergence = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2
        return F.when(total > 0, F.sqrt(F.greatest(F.least(divergence, F.lit(1.0)), F.lit(0.0))))

    return let(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), distance)


def _word_limit(shares: list[float]) -> float:
    """Jensen-Shannon distance of a text that has the common words ``LEAST_COMMON`` times as often."""
    few = [LEAST_COMMON * x for x in shares[:-1]]
    few.append(1 - sum(few))
    part = lambda v, half: v * math.log2(v / half) if v > 0 else 0.0
    return math.sqrt(sum(part(v, (x + y) / 2) for x, y in zip(few, shares) for v in (x, y)) / 2)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list, list]]:
    """Shares of character classes and common words by language, over documents of 20 words or more."""
    t = whole_text(text)

    def counted(h: Column) -> Column:
        vocabulary = F.when(F.lit(False), F.array().cast("array<bigint>"))
        for name in COMMON:
            vocabulary = vocabulary.when(F.col(lang) == name, _vocabulary(h, name))
        return F.struct(h["characters"].alias("characters"), vocabulary.alias("vocabulary"))

    own = let(_words(t), lambda w: F.when(F.size(w) >= MIN_WORDS, let(_histograms(t, w), counted)))
    rows = docs.select(_known(F.col(lang)).alias("lang"), own.alias("own"))
    width = max(map(len, COMMON.values())) + 1
    sums = [F.sum(F.get("own.characters", i)).alias(f"c{i}") for i in range(6)]
    sums += [F.sum(F.get("own.vocabulary", i)).alias(f"w{i}") for i in range(width)]

    def shares(values: list) -> list[float]:
        total = sum(v or 0 for v in values)
        return [(v or 0) / total for v in values] if total else []

    found = {}
    for row in rows.groupBy("lang").agg(*sums).collect():  # a row a language listed above, and one for the others
        words = [row[f"w{i}"] for i in range(len(COMMON[row["lang"]]) + 1)] if row["lang"] in COMMON else []
        found[row["lang"]] = shares([row[f"c{i}"] for i in range(6)]), shares(words)
    return found


def _repeated_words(words: Column) -> Column:
    """Words in windows of ``REPEAT`` words that are in the text twice or more."""
    hashes = window_hashes(F.transform(words, lambda x: F.xxhash64(x)), REPEAT)
    twice = lambda s: pairwise(
        s, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
    )
    places = lambda h: F.sort_array(
        F.array_distinct(F.flatten(twice(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))))
    )
    covered = lambda p: F.aggregate(
        pairwise(p, 1, lambda a, b: F.least(b - a, F.lit(REPEAT))), F.lit(REPEAT), lambda x, y: x + y
    )
    count = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(0)
    return let(hashes, count).cast("long")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``quality``: measures and distances, base_failed and kept.

    Words are divided by ASCII white space. A document fails the base rules with fewer than
    20 words, or if more than 30 % of its words lie in 8-word windows that occur twice or
    more in it. It is kept if it passes them, its characters are no further from the nearest
    language than the limit, and its words are within the limit of a language. Documents below
    the guards have null distances; those without a label of a listed language have a null
    word distance.

    Windows within a text are compared by 64-bit hash. A null text is an empty one and is
    not kept. Each row is judged by itself, so repeated rows and ids stay; other columns
    stay, a column named ``quality`` is replaced. Documents of an unknown
    or null language share one reference. An empty table gives an empty one.
    """
    references = language_references(docs, text, lang)

    limits = [F.lit(_word_limit(words)) for _, words in references.values() if words]

    def distances(i: int, histogram: Callable[[str], Column]) -> Column:
        own = [_distance(histogram(name), F.array(*map(F.lit, r[i]))) for name, r in references.items() if r[i]]
        return F.array(*own).cast("array<double>")

    def beyond(own: Column) -> Column:
        """The least distance, and by how much it is above the limit where that is least."""
        above = F.zip_with(own, F.array(*limits).cast("array<double>"), lambda x, y: x - y)
        return F.struct(F.array_min(own).alias("distance"), F.array_min(above).alias("above"))

    def measured(t: Column, w: Column, h: Column) -> Column:
        n_words = F.size(w).cast("long")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        n_dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        by_class = F.when(F.length(t) >= GUARD_CHARS, F.array_min(distances(0, lambda name: h["characters"])))
        by_word = F.when((n_words >= GUARD_WORDS) & F.col(lang).isin(list(COMMON)), let(distances(1, lambda name: _vocabulary(h, name)), beyond))
        return F.struct(
            n_words.alias("n_words"), h["inside"].alias("word_chars"), h["symbols"].alias("n_symbols"),
            n_dup_lines.alias("n_dup_lines"), _repeated_words(w).alias("n_repeat_words"),
            by_class.alias("character_distance"), by_word.alias("words"),
        )

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED * q["n_words"])
        far = F.coalesce(q["character_distance"] > MAX_CHARACTER_DISTANCE, F.lit(False))
        far = far | F.coalesce(q["words"]["above"] > 0, F.lit(False))
        measures = q.withField("word_distance", q["words"]["distance"]).dropFields("words")
        return F.struct(measures.alias("measures"), failed.alias("base_failed"), (~failed & ~far).alias("kept"))

    t = whole_text(text)
    found = let(_words(t), lambda w: let(_histograms(t, w), lambda h: let(measured(t, w, h), judged)))
    kept = [c for c in docs.columns if c != "quality"]
    return docs.select(*kept, found.alias("quality"))


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    measured = quality_rules(docs.select("doc_id", "text", "lang"))
    base = "n_words word_chars n_symbols n_dup_lines n_repeat_words"
    return measured.select(
        "doc_id", *[f"quality.measures.{c}" for c in base.split()], "quality.base_failed", "quality.kept",
        "quality.measures.character_distance", "quality.measures.word_distance",
    )
