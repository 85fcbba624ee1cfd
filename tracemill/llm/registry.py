"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm.bottom_k import op12_minhash_dedup
from tracemill.llm.centroid_clusters import op11_centroid_clusters
from tracemill.llm.common import table
from tracemill.llm.cotraining import op4_quality_classifier
from tracemill.llm.decontaminate import op2_benchmark_decontamination
from tracemill.llm.jaccard_join import op6_jaccard_join
from tracemill.llm.license_scan import op1_license_scan
from tracemill.llm.mix_sources import op8_mix_sources
from tracemill.llm.oracles import all_oracles as all_oracles
from tracemill.llm.pseudonyms import op9_pii_pseudonyms
from tracemill.llm.quality_rules import op7_quality_rules
from tracemill.llm.secret_scan import op5_secret_scan
from tracemill.llm.substring_dedup import op10_substring_dedup
from tracemill.llm.token_alignment import op13_token_alignment
from tracemill.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(table(spark, folder, "documents"))


def _with_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return op2_benchmark_decontamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_license_scan": _over_documents(op1_license_scan),
        "op2_benchmark_decontamination": _decontamination,
        "op3_toxicity": _with_labels(op3_toxicity),
        "op4_quality_classifier": _with_labels(op4_quality_classifier),
        "op5_secret_scan": _over_documents(op5_secret_scan),
        "op6_jaccard_join": _over_documents(op6_jaccard_join),
        "op7_quality_rules": _over_documents(op7_quality_rules),
        "op8_mix_sources": _over_documents(op8_mix_sources),
        "op9_pii_pseudonyms": _over_documents(op9_pii_pseudonyms),
        "op10_substring_dedup": _over_documents(op10_substring_dedup),
        "op11_centroid_clusters": lambda spark, folder: op11_centroid_clusters(table(spark, folder, "embeddings")),
        "op12_minhash_dedup": _over_documents(op12_minhash_dedup),
        "op13_token_alignment": _over_documents(op13_token_alignment),
    }
