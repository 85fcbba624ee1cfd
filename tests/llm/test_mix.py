"""The mix with one hot id, and with equal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.llm.mix_sources import mix_sources


@pytest.mark.parametrize("text", ["different", "the same"])
@pytest.mark.parametrize("null", [False, True])
def test_one_hot_id_spreads(spark, text, null):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = F.col("id") % 3 == 0
        own = F.when(hot & (text == "the same"), F.lit("equal")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
        key = F.when(hot, F.lit(None) if null else F.lit(7)).otherwise(F.col("id") + 100).cast("long")
        docs = spark.range(0, 30_000, 1, 64).select(key.alias("doc_id"), own.alias("text"), F.lit("s").alias("source"))
        mixed = mix_sources(docs, weights={"s": 1.0}, total=60_000)
        sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
        in_order = mixed.select("mix_key", F.spark_partition_id().alias("p")).toPandas().groupby("p")["mix_key"]
        assert all(keys.is_monotonic_increasing for _, keys in in_order)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
