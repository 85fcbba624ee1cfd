"""Operators over events in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.skew import SLICE, ordered_slices


def adjacent_pairs(
    df: DataFrame,
    part: str | Sequence[str],
    a: int,
    b: int,
    time: str = "time",
    tie: Sequence[str] = (),
    kind: str = "event_type",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Events of type ``a`` directly followed by one of type ``b`` in their partition.

    Rows are ordered by time, then the ``tie`` columns, the event type and the
    ``carry`` columns; any event in between cancels a pair. The result has the
    partition columns, the ``carry`` columns of the first event, its ``time`` and
    ``elapsed``, the time to the second. Rows without a time are left out.

    Rows are sorted in slices of their order, whatever the size of a partition or of
    an instant; pairs that straddle slices come from the first and last row of each.
    """
    part = [part] if isinstance(part, str) else list(part)
    place = list(dict.fromkeys([time, *tie, kind]))
    shown = [c for c in dict.fromkeys([*carry, time]) if c not in part]
    extra = [c for c in shown if c not in place]
    order = [*place, *extra]
    rows = df.select(*dict.fromkeys([*part, *order])).filter(F.col(time).isNotNull())
    if not tie and a != b:
        # Of events alike in all but the carried columns only the last can begin a pair,
        # so copies merge before they move.
        last = F.max(F.struct(F.lit(0), *extra)).alias("_last")
        alike = list(dict.fromkeys([*part, *place]))
        rows = rows.groupBy(*alike).agg(last).select(*alike, *[f"_last.{c}" for c in extra])

    inside = Window.partitionBy(*part, SLICE).orderBy(*order)
    seen = ordered_slices(rows, part, [c for c in order if c not in part]).select(
        "*",
        F.lead(kind).over(inside).alias("_kind"),
        F.lead(time).over(inside).alias("_time"),
        F.row_number().over(inside).alias("_number"),
    )
    # A pair within a slice is done; the ends of a slice go on as rows of their own.
    pair = F.coalesce((F.col(kind) == a) & (F.col("_kind") == b), F.lit(False))
    last = F.col("_time").isNull()
    roles = F.filter(
        F.array(F.when(pair, F.lit("pair")), F.when(last | (F.col("_number") == 1), F.lit("end"))),
        lambda role: role.isNotNull(),
    )
    few = seen.withColumn("_last", last).withColumn("_role", F.explode(roles))
    apart = F.when(F.col("_role") == "pair", F.col(SLICE))
    across = Window.partitionBy(*part, "_role", apart).orderBy(SLICE, *order)
    followed = few.select(
        *part, *shown, "_role", "_last",
        F.when(F.col("_role") == "pair", F.col("_time")).otherwise(F.lead(time).over(across)).alias("_time"),
        ((F.col(kind) == a) & (F.lead(kind).over(across) == b)).alias("_straddles"),
    )
    return followed.filter((F.col("_role") == "pair") | (F.col("_last") & F.col("_straddles"))).select(
        *part, *shown, (F.col("_time") - F.col(time)).alias("elapsed")
    )


def above_mean(df: DataFrame, col: str, k: float = 2, mean: Column | None = None) -> DataFrame:
    """Rows whose value is above ``k`` times the overall mean, or a mean given."""
    mean = df.agg(F.avg(col)).scalar() if mean is None else mean
    return df.filter(F.col(col) > F.lit(k) * mean)
