"""From documents to a training mix, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns of
documents. Texts of a benchmark come from the benchmark table below ``sf_dir``.

A null or empty text fails the quality rules and goes first, as does what is too short or
repeats itself. Rows that repeat an id and a text leave one row at the join. An empty table
of documents gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import staged, table
from tracemill.llm.decontaminate import benchmark_hits
from tracemill.llm.jaccard_join import keep_one
from tracemill.llm.mix_sources import mix_sources
from tracemill.llm.quality_rules import quality_rules
from tracemill.llm.secret_scan import redact_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs.select(*COLUMNS)).where("quality.kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much of the benchmark."""
    hits = benchmark_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return hits.where(~F.col("hits.contaminated")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the texts; n_chars follows."""
    masked = redact_secrets(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    return mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing sources", mix),
]
# The quality references, the components and the randomness battery are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
