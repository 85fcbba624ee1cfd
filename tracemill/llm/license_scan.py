"""License scans by diagonal voting.

Every run of 2 and of 4 words of a text is hashed and joined to the places of the same
run in the license templates. A hit at document word p and template word t votes for the
diagonal p - t. Votes are counted by diagonal, neighbouring diagonals of one template
merge (an inserted or lost word moves the diagonal), and a merged span counts if enough of
the template's runs voted. A vote is given only after the words themselves agree.

Phrases vote with runs of 2 words and must agree in full on one diagonal; notices, and
templates of the caller's, vote with runs of 4 and may have any length. The runs of up to
``LISTED`` are broadcast, some 150 bytes each; a larger pack is joined by a shuffle in which
the commonest runs are salted.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import NOT_WORD, fresh, heavy_keys, salted_join, staged, whole_text
from tracemill.llm.license_texts import BASE_PHRASES, NOTICES, PHRASES
from tracemill.llm.quality_rules import pairwise, window_hashes

PHRASE_RUN, NOTICE_RUN = 2, 4
NEAR = 3  # diagonals of one template this close merge
ENOUGH = 0.6  # share of a notice's runs
LISTED = 100_000  # runs of templates that are broadcast
DOCUMENT = -1  # the vote of a document for itself


def _run_hashes(words, width: int):
    return window_hashes(F.transform(words, lambda w: F.xxhash64(w)), width)


def templates(spark: SparkSession, more: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The runs of all templates: hash, template, place, words; and per template label, runs and kind.

    ``more`` has (label, text) of templates besides the pack, of at least 4 words."""
    rows = [(label, text, PHRASE_RUN, True) for label, text in BASE_PHRASES]
    rows += [(label, text, PHRASE_RUN, False) for label, text in PHRASES]
    rows += [(label, text, NOTICE_RUN, False) for label, text in NOTICES]
    rows += [(label, " ".join(re.split(NOT_WORD, text.lower())).strip(), NOTICE_RUN, False) for label, text in more]
    rows = [(i, *row, len(row[1].split()) - row[2] + 1) for i, row in enumerate(rows)]
    if any(row[-1] < 1 for row in rows):
        raise ValueError("a template needs at least 4 words")
    schema = "template int, label string, words string, width int, base boolean, runs int"
    t = spark.createDataFrame(rows, schema).withColumn("words", F.split("words", " "))
    hashed = F.when(F.col("width") == PHRASE_RUN, _run_hashes(F.col("words"), PHRASE_RUN)).otherwise(
        _run_hashes(F.col("words"), NOTICE_RUN)
    )
    runs = t.select("*", F.posexplode(hashed).alias("at", "run")).withColumn("words", F.expr("slice(words, at + 1, width)"))
    own = spark.range(1).select(
        F.lit(DOCUMENT).alias("template"), F.lit("").alias("label"), F.array().cast("array<string>").alias("words"),
        F.lit(0).alias("width"), F.lit(False).alias("base"), F.lit(1).alias("runs"), F.lit(0).alias("at"),
        F.lit(0).cast("long").alias("run"),
    )
    return runs.unionByName(own)


def license_spans(
    docs: DataFrame, text: str = "text", key: str = "doc_id", more: Sequence[tuple[str, str]] = (), listed: int = LISTED
) -> DataFrame:
    """Per row of ``docs``: ``key``, n_words, base places, labels and the spans found.

    ``spans`` has (label, first word, end, share of the template's runs, base) of every
    phrase place and every merged span with at least 60 % of a notice. Words are ASCII
    digits and letters and all characters beyond ASCII, compared without regard to case.
    ``more`` adds templates (label, text) of any length to the pack; at most ``listed`` runs
    of templates are broadcast.

    A null or empty text has no words and no spans. Rows are told apart by their place in
    the scan, so repeated rows, repeated and null keys each keep a row. Other columns are
    not looked at. An empty table gives no rows.
    """
    row, words, hashes = fresh("row"), fresh("words"), fresh("hashes")
    spans = docs.select(
        F.monotonically_increasing_id().alias(row),
        F.col(key).alias("key"),
        F.array_remove(F.split(F.lower(whole_text(text)), NOT_WORD), "").alias(words),
    )
    spans = spans.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    spans = spans.withColumn("pairs", pairwise(F.col(hashes), 1, lambda a, b: F.xxhash64(a, b)))
    fours = pairwise(F.col("pairs"), 2, lambda a, b: F.xxhash64(a, b))
    runs = F.concat(F.array(F.lit(0).cast("long")), F.col("pairs"), fours)
    spans = spans.select(row, "key", words, F.size(words).cast("long").alias("n_words"), runs.alias("runs_of"))
    votes = spans.select(row, "key", "n_words", words, F.posexplode_outer("runs_of").alias("nth", "run"))
    # Never empty, and outer, so that no filter computes the hashes twice. The first element is the document's own vote, then the pairs, then the fours.
    n_pairs = F.greatest(F.col("n_words") - (PHRASE_RUN - 1), F.lit(0))
    pack = templates(docs.sparkSession, more)
    if len(more) == 0 or pack.count() <= listed:
        votes = votes.join(F.broadcast(pack), "run")
    else:  # staged, as the numbers of the rows must be the same for both uses
        votes = staged(votes, "license-runs")
        votes = salted_join(votes, staged(pack, "license-templates"), "run", heavy_keys(votes, "run"))
    place = F.when(F.col("width") == 0, 0).when(F.col("width") == PHRASE_RUN, F.col("nth") - 1)
    votes = votes.withColumn("place", place.otherwise(F.col("nth") - 1 - n_pairs).cast("int"))
    votes = votes.where(
        ((F.col("width") == PHRASE_RUN) == ((F.col("nth") >= 1) & (F.col("nth") <= n_pairs)))
        & ((F.col("width") == 0) == (F.col("nth") == 0))
        & (F.slice(words, F.col("place") + 1, F.col("width")) == F.col("words"))
    )
    document = [row, "key", "n_words"]
    kind = ["template", "label", "width", "base", "runs"]
    diagonals = votes.groupBy(*document, *kind, (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("voted"),
        F.min("place").alias("first"),
        F.max(F.col("place") + F.col("width")).alias("end"),
    )
    along = Window.partitionBy(row, "template").orderBy("diagonal")
    near = F.when(F.col("width") == NOTICE_RUN, NEAR).otherwise(0)
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    diagonals = diagonals.withColumn("new", F.when(gap <= near, 0).otherwise(1))
    diagonals = diagonals.withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.size(F.array_distinct(F.flatten(F.collect_list("voted")))) / F.max("runs")
    merged = diagonals.groupBy(*document, *kind, "span").agg(
        share.alias("share"), F.min("first").alias("first"), F.max("end").alias("end")
    )
    found = (F.col("template") >= 0) & (F.col("share") >= F.when(F.col("width") == NOTICE_RUN, ENOUGH).otherwise(1.0))
    base = found & F.col("base")
    span = F.struct(F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end"), "label", "share", "base")
    labels = lambda of: F.array_sort(F.collect_set(F.when(of, F.col("label"))))
    return (
        merged.groupBy(*document)
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(found).alias("labels"),
            F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("share"))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(found, span))).alias("spans"),
        )
        .drop(row)
        .withColumnRenamed("key", key)
    )


def op1_license_scan(docs: DataFrame) -> DataFrame:
    found = license_spans(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
        F.to_json("spans").alias("spans"),
    )
