"""Inner equi-joins and the one-row combination of scalar results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.clean import positive, require_fields

TASK = ["job_id", "task_index"]


def join_counts(
    a: DataFrame, b: DataFrame, key: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Two per-key aggregates side by side. Both are one row per key and already
    partitioned by it; ``how="left"`` keeps keys that only ``a`` has."""
    return a.join(b, key, how)


def task_requests(task_events: DataFrame, first_only: bool = False) -> DataFrame:
    """Requested resources per task event, both above 0; optionally only the task's
    first such event."""
    measures = ["cpu_request", "memory_request"]
    rows = positive(require_fields(task_events, TASK), measures)
    if first_only:
        first = F.min(F.struct("time", *measures)).alias("first")
        return rows.groupBy(*TASK).agg(first).select(*TASK, *[f"first.{m}" for m in measures])
    return rows.select(*TASK, *measures)


def task_samples(task_usage: DataFrame) -> DataFrame:
    """Measured resources per usage sample, both above 0."""
    rows = task_usage.select(
        *TASK,
        F.col("cpu_rate").alias("cpu_usage"),
        F.col("canonical_memory_usage").alias("memory_usage"),
    )
    return positive(require_fields(rows, TASK), ["cpu_usage", "memory_usage"])


def join_request_usage(
    task_events: DataFrame, task_usage: DataFrame, first_only: bool = True
) -> DataFrame:
    """The first request of a task next to each of its usage samples, one row per sample.

    With ``first_only=False`` every request of a task meets every sample, so a task
    with many of both yields their product. For the correlations over all of these
    use ``request_usage_correlation``, which never forms the rows.
    """
    requests = task_requests(task_events, first_only)
    return requests.join(task_samples(task_usage), TASK).select(
        *TASK, "cpu_request", "memory_request", "cpu_usage", "memory_usage"
    )


def request_usage_correlation(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """Pearson correlations over the many-to-many join of requests and samples,
    computed from sums per task.

    Each side is aggregated per task before the only join, which is then one row to
    one row: a request value counts once for every sample of its task and the other
    way round, and the sum of products of a task is the product of its sums. Values
    are taken relative to their side's mean, so that sums of squares keep their digits.
    """
    measures = {"cpu": ("cpu_request", "cpu_usage"), "memory": ("memory_request", "memory_usage")}

    def sums(df: DataFrame, side: int, count: str) -> DataFrame:
        columns = [pair[side] for pair in measures.values()]
        origin = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
        near = df.select(*TASK, *[(F.col(c) - origin[c]).alias(c) for c in columns])
        return near.groupBy(*TASK).agg(
            F.count(F.lit(1)).alias(count),
            *[F.sum(c).alias(c) for c in columns],
            *[F.sum(F.col(c) * F.col(c)).alias(f"{c}_squares") for c in columns],
            *[F.min(c).alias(f"{c}_min") for c in columns],
            *[F.max(c).alias(f"{c}_max") for c in columns],
        )

    tasks = sums(requests, 0, "n").join(sums(samples, 1, "m"), TASK)
    n, m = F.col("n"), F.col("m")
    # The number of pairs is a decimal, since the product of two hot counts passes 64 bits.
    pairs = F.coalesce(F.sum(n.cast("decimal(19,0)") * m), F.lit(0)).cast("decimal(38,0)")

    def correlation(x: str, y: str) -> Column:
        def mean(total: Column) -> Column:
            return F.try_divide(F.sum(total), pairs.cast("double"))

        x_mean, y_mean = mean(m * F.col(x)), mean(n * F.col(y))
        x_var = mean(m * F.col(f"{x}_squares")) - x_mean * x_mean
        y_var = mean(n * F.col(f"{y}_squares")) - y_mean * y_mean
        covariance = mean(F.col(x) * F.col(y)) - x_mean * y_mean
        varies = (F.min(f"{x}_min") < F.max(f"{x}_max")) & (F.min(f"{y}_min") < F.max(f"{y}_max"))
        spread = F.sqrt(F.greatest(x_var, F.lit(0.0))) * F.sqrt(F.greatest(y_var, F.lit(0.0)))
        return F.when(varies, F.try_divide(covariance, spread))

    return tasks.agg(
        pairs.alias("pairs"),
        *[correlation(x, y).alias(f"{name}_correlation") for name, (x, y) in measures.items()],
    )


def scalar_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side as one row, through scalar subqueries."""
    rows = [(f.columns, f.select(F.struct("*")).scalar()) for f in frames]
    return frames[0].sparkSession.range(1).select(
        *[row[c].alias(c) for columns, row in rows for c in columns]
    )
