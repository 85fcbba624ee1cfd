"""Grouped and global aggregates.

Each is a partial aggregate in the scan stage and one shuffle of the partial
results, so a key that holds a large share of the rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def distribution(
    df: DataFrame, key: str | Sequence[str], distinct: str | None = None, alias: str = "count"
) -> DataFrame:
    """Rows per key, or distinct values of ``distinct`` per key."""
    counted = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    return df.groupBy(*_keys(key)).agg(counted.alias(alias))


def count_if_by(
    df: DataFrame, key: str | Sequence[str], cond: Column, alias: str = "matches", total: str = "total"
) -> DataFrame:
    """Rows per key that meet a condition, next to all rows per key, in one pass."""
    return df.groupBy(*_keys(key)).agg(
        F.count_if(cond).alias(alias), F.count(F.lit(1)).alias(total)
    )


def distinct_per_key(
    df: DataFrame, key: str | Sequence[str], value: str, approx: bool = False, alias: str = "distinct"
) -> DataFrame:
    """Distinct values per key. The exact form first shuffles by key and value, so
    a hot key is spread over tasks."""
    n = F.approx_count_distinct(value) if approx else F.countDistinct(value)
    return df.groupBy(*_keys(key)).agg(n.alias(alias))


def distinct_sketches(df: DataFrame, keys: Sequence[str], value: str, precision: int = 14) -> DataFrame:
    """Per key a sketch of its distinct values, of at most 2 ^ ``precision`` cells, to be stored and merged.

    With keys such as an hour and a class, distinct counts of any span and set of classes come from
    the sketches without the rows; they are off by some 1.04 / 2 ^ (``precision`` / 2)."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def distinct_of_sketches(sketches: DataFrame, keys: Sequence[str] = (), alias: str = "distinct") -> DataFrame:
    """Distinct values per key of stored sketches, merged over all other keys."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(alias))


def one_or_several(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key 1 if all its values are the same, 2 if they differ and 0 if it has none.

    Enough to tell one from several; needs only minimum and maximum per key
    instead of a shuffle of every distinct value."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(key).agg(
        F.when(low < high, 2).when(low == high, 1).otherwise(0).alias("values")
    )


def split_counts(
    df: DataFrame, n: str, single: str = "single", several: str = "several"
) -> DataFrame:
    """Groups whose ``n`` is exactly one, and groups above one, as one row."""
    return df.agg(F.count_if(F.col(n) == 1).alias(single), F.count_if(F.col(n) > 1).alias(several))


def sums_by(df: DataFrame, keys: Sequence[str], sums: dict[str, Column | str]) -> DataFrame:
    """Sum of each measure per composite key; ``sums`` maps result name to measure."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in sums.items()]
    )


def max_by_key(df: DataFrame, key: str, maxima: dict[str, str]) -> DataFrame:
    """Maximum of each measure per key; ``maxima`` maps result name to measure."""
    return df.groupBy(key).agg(*[F.max(c).alias(name) for name, c in maxima.items()])


def mean_by(df: DataFrame, key: str | Sequence[str], col: str, alias: str = "mean") -> DataFrame:
    return df.groupBy(*_keys(key)).agg(F.avg(col).alias(alias))


def summary(df: DataFrame, col: str) -> DataFrame:
    """Sum, minimum, maximum and mean of a column in one pass, as one row."""
    return df.agg(
        F.sum(col).alias("sum"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.avg(col).alias("mean"),
    )


def pearson_of(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate expression over rows where both sides are present.

    NULL for zero variance or fewer than two rows, where ``corr`` would raise."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def pearson(df: DataFrame, x: str, y: str, alias: str = "correlation") -> DataFrame:
    return df.agg(pearson_of(x, y).alias(alias))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal-width bins between minimum and maximum, empty ones
    included; the last bin is closed. A column with a single value spans half a
    unit on either side of it."""
    values = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    bounds = (
        values.agg(F.min("x").alias("min"), F.max("x").alias("max"))
        .select(
            F.struct(
                F.when(F.col("min") == F.col("max"), F.col("min") - 0.5)
                .otherwise(F.col("min"))
                .alias("lo"),
                F.when(F.col("min") == F.col("max"), F.col("max") + 0.5)
                .otherwise(F.col("max"))
                .alias("hi"),
            )
        )
        .scalar()
    )
    lo, width = bounds["lo"], (bounds["hi"] - bounds["lo"]) / bins
    bin_of = F.least(F.floor((F.col("x") - lo) / width).cast("int"), F.lit(bins - 1))
    counts = values.select(bin_of.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return all_bins(counts, bins, lo, width)


def all_bins(counts: DataFrame, bins: int, lo: Column, width: Column) -> DataFrame:
    """Add the empty bins and the edges to counts per bin."""
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select(  # at most one row per bin
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
