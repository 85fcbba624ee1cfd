"""Start and end events of an entity, every start paired with every end.

The number of pairs of a key is the product of its starts and ends. The totals,
the longest pairs and the histogram are therefore taken from the events
themselves; only ``event_pairs`` forms the rows. Times are integer microseconds
and all sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import seconds
from tracemill.operators.aggregate import all_bins
from tracemill.operators.clean import events_in, require_fields
from tracemill.operators.skew import SLICE, ordered_slices

# Wide enough for counts and 64-bit times, and for the product of a count and a sum of times.
WIDE = "decimal(20,0)"
WIDEST = "decimal(38,0)"
# A key with more pairs per event than this is counted without forming its pairs.
FORMED = 8
# A key with more than one in so many of all events is dealt into parts of that size, or of so many
# events in a small table. There are fewer such keys than ``SHARE``.
SHARE, PART = 1000, 1000


def pair_events(
    df: DataFrame,
    start: int,
    end: int,
    key: str = "job_id",
    time: str = "time",
    kind: str = "event_type",
    first_only: bool = False,
) -> DataFrame:
    """The start and end events as (key, t, is_start), the input of the operators below.

    ``first_only`` keeps the first start and the first end of each key."""
    rows = events_in(require_fields(df, [key, time]), [start, end], kind).select(
        F.col(key).alias("key"), F.col(time).alias("t"), (F.col(kind) == start).alias("is_start")
    )
    if first_only:
        rows = rows.groupBy("key", "is_start").agg(F.min("t").alias("t"))
    return rows


def event_pairs(events: DataFrame, first_only: bool = True) -> DataFrame:
    """(key, elapsed) in microseconds for the first start and the first end of a key.

    One aggregate and no join; elapsed is negative where the end precedes the start.
    With ``first_only=False`` every start meets every end, and a key with many of both
    yields their product: for counts, totals or bins of all pairs use the functions
    below, which do not form them."""
    if first_only:
        first = events.groupBy("key").agg(
            F.min(F.when(F.col("is_start"), F.col("t"))).alias("s"),
            F.min(F.when(~F.col("is_start"), F.col("t"))).alias("e"),
        )
        pairs = require_fields(first, ["s", "e"])
    else:
        pairs = every_pair(events, pair_totals(events))
    return pairs.select("key", (F.col("e") - F.col("s")).alias("elapsed"))


def _parted(totals: DataFrame, share: int = SHARE, part: int = PART) -> DataFrame:
    """The totals with the numbers of parts of their keys' starts, ends and both: 1 but for hot keys."""
    every = totals.agg(F.sum(F.col("start_n") + F.col("end_n")).alias("every")).scalar()
    parts = lambda c: F.greatest(F.ceil(c / F.col("size")), F.lit(1)).cast("int")
    sized = totals.withColumn("size", F.greatest(every / share, F.lit(part).cast(WIDEST)))
    return sized.select(
        *totals.columns, parts(F.col("start_n")).alias("start_parts"), parts(F.col("end_n")).alias("end_parts"),
        parts(F.col("start_n") + F.col("end_n")).alias("parts"),
    )


def hot_keys(parted: DataFrame) -> DataFrame:
    """Keys with more than one in ``SHARE`` of all events that have pairs, fewer than so many rows: key, and the
    numbers of parts for its starts, its ends and both, in proportion to them."""
    return parted.filter(F.col("parts") > 1).select("key", "start_parts", "end_parts", "parts")


def _dealt(parts: str) -> Column:
    """The part of a row of a hot key, 0 for others. Events of one instant differ by the task that reads them."""
    return F.pmod(F.xxhash64("t", F.spark_partition_id()), F.coalesce(parts, F.lit(1))).cast("int")


def _each(parts: str) -> Column:
    """A row for every part."""
    return F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))


def every_pair(events: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """(key, s, e): every start of a key with every one of its ends.

    Starts and ends of a hot key are dealt into parts, and each part of the one is copied to all
    of the other, so no task has more than a ``share`` of either side; a side with few rows is one
    part, so the other isn't copied."""
    return _formed(events.join(F.broadcast(hot_keys(_parted(totals, share))), "key", "left"))


def _formed(marked: DataFrame) -> DataFrame:
    """The pairs of events with the numbers of parts of their keys."""
    starts = marked.filter("is_start").select("key", F.col("t").alias("s"), _dealt("start_parts").alias("i"), "end_parts")
    ends = marked.filter("not is_start").select("key", F.col("t").alias("e"), _dealt("end_parts").alias("j"), "start_parts")
    starts = starts.select("key", "s", "i", _each("end_parts").alias("j"))
    ends = ends.select("key", "e", _each("start_parts").alias("i"), "j")
    return starts.join(ends, ["key", "i", "j"]).select("key", "s", "e")


def pair_totals(events: DataFrame) -> DataFrame:
    """Per key the number of pairs, and their total, shortest and longest elapsed time.

    One aggregate, no join: the total over all pairs is the number of starts times
    the sum of end times less the number of ends times the sum of start times."""

    def side(is_start: bool, name: str) -> list[Column]:
        t = F.when(F.col("is_start") == is_start, F.col("t"))
        return [
            F.count(t).cast(WIDE).alias(f"{name}_n"),
            F.sum(t.cast(WIDE)).alias(f"{name}_sum"),
            F.min(t).alias(f"{name}_min"),
            F.max(t).alias(f"{name}_max"),
        ]

    sides = events.groupBy("key").agg(*side(True, "start"), *side(False, "end"))
    total = F.col("start_n") * F.col("end_sum") - F.col("end_n") * F.col("start_sum")
    # Names all aggregates, so that whoever uses the totals shares one shuffle of them.
    both = F.col("start_sum").isNotNull() & F.col("end_sum").isNotNull()
    for name in ("start_min", "start_max", "end_min", "end_max"):
        both = both & F.col(name).isNotNull()
    return sides.filter(both & (F.col("start_n") > 0) & (F.col("end_n") > 0)).select(
        "key",
        "start_n",
        "end_n",
        (F.col("start_n") * F.col("end_n")).cast(WIDEST).alias("pairs"),
        total.cast(WIDEST).alias("total"),
        (F.col("end_min") - F.col("start_max")).alias("shortest"),
        (F.col("end_max") - F.col("start_min")).alias("longest"),
        "end_min",
        "end_max",
    )


def pair_mean(totals: DataFrame) -> DataFrame:
    """Number of pairs and mean elapsed seconds over all of them, as one row."""
    pairs, total = F.sum("pairs").cast(WIDEST), F.sum("total").cast(WIDEST)
    mean = F.try_divide(total.cast("double"), pairs.cast("double"))
    return totals.agg(
        F.coalesce(pairs, F.lit(0)).cast(WIDEST).alias("pairs"), seconds(mean).alias("mean")
    )


def longest_pairs(
    events: DataFrame, totals: DataFrame, n: int = 10, above: Column | None = None
) -> DataFrame:
    """The ``n`` longest pairs as (key, elapsed), by elapsed descending, then key.

    They come from the ``n`` keys with the longest single pair, and within a key
    from its ``n`` earliest starts and ``n`` latest ends, so no more than n * n
    pairs per key are formed. ``above`` keeps only pairs with more elapsed microseconds.
    """
    keys = totals.orderBy(F.desc("longest"), "key").limit(n).select("key")
    few = events.join(F.broadcast(keys), "key", "left_semi")  # n keys
    extreme = F.when(F.col("is_start"), F.col("t")).otherwise(-F.col("t"))
    rank = F.row_number().over(Window.partitionBy("key", "is_start").orderBy("extreme"))
    few = few.withColumn("extreme", extreme).withColumn("rank", rank).filter(F.col("rank") <= n)
    # At most n starts and n ends per key, so the lists are short.
    sides = few.groupBy("key").agg(
        F.collect_list(F.when(F.col("is_start"), F.col("t"))).alias("starts"),
        F.collect_list(F.when(~F.col("is_start"), F.col("t"))).alias("ends"),
    )
    pairs = sides.select("key", "ends", F.explode("starts").alias("s")).select(
        "key", "s", F.explode("ends").alias("e")
    )
    pairs = pairs.select("key", (F.col("e") - F.col("s")).alias("elapsed"))
    if above is not None:
        pairs = pairs.filter(F.col("elapsed") > above)
    return pairs.orderBy(F.desc("elapsed"), "key").limit(n)


def pair_histogram(events: DataFrame, totals: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of the elapsed seconds of all pairs in ``bins`` equal-width bins.

    Pairs of keys with few per event are formed, which is linear in the events. For the
    others, the pairs below each inner edge are counted by a running count of the key's
    ends, looked up at every start shifted by the edge. Both are always part of the plan.
    Counts are decimals, since the product of two hot counts passes 64 bits.
    """
    one_value = F.col("min") == F.col("max")
    half = F.when(one_value, 500_000).otherwise(0)  # half a second on either side
    # A pair lies in bin i or above if its elapsed time is at least edge i.
    edge = lambda i: F.ceil(i * F.col("span") / bins + F.col("lo")).cast("long")
    bounds = (
        totals.agg(F.min("shortest").alias("min"), F.max("longest").alias("max"))
        .select(
            (F.col("min") - half).cast(WIDE).alias("lo"), (F.col("max") + half).cast(WIDE).alias("hi")
        )
        .select("lo", (F.col("hi") - F.col("lo")).cast(WIDE).alias("span"))
        .select(
            F.struct(
                "lo",
                "span",
                F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), edge).alias("edges"),
            )
        )
        .scalar()
    )
    lo, span = bounds["lo"], bounds["span"]

    # Keys to be counted; the totals of a hot one in as many copies as its events have parts.
    parted = _parted(totals)
    hot = F.broadcast(hot_keys(parted))  # fewer than SHARE rows
    dense = parted.filter(F.col("pairs") > FORMED * (F.col("start_n") + F.col("end_n")))
    of_key = dense.select("key", "end_n", "end_min", "end_max", _each("parts").alias("part"))
    marked = events.join(hot, "key", "left").withColumn("part", _dealt("parts")).join(of_key, ["key", "part"], "left")
    formed = _formed(marked.filter(F.col("end_n").isNull())).select((F.col("e") - F.col("s")).alias("elapsed"))

    # Whole-number division: a rounded quotient could reach the next bin.
    offset = (F.col("elapsed").cast(WIDE) - lo) * bins
    bin_of = F.least(F.call_function("div", offset, span).cast("int"), F.lit(bins - 1))
    counts = formed.select(bin_of.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).cast(WIDEST).alias("count"))
    everything = dense.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast(WIDEST)).scalar()
    below = _pairs_below(marked.filter(F.col("end_n").isNotNull()), bounds["edges"])
    counts = counts.unionByName(_between(below, bins, everything))
    counts = counts.groupBy("bin").agg(F.sum("count").cast(WIDEST).alias("count"))
    width = seconds(span.cast("double")) / bins
    return all_bins(counts, bins, seconds(lo.cast("double")), width)


def _pairs_below(events: DataFrame, edges: Column) -> DataFrame:
    """(i, below): pairs with less elapsed time than edge i, over keys marked with their totals."""
    ends = events.filter(~F.col("is_start")).select("key", F.col("t").alias("at"), F.lit(0).alias("i"))
    probes = (
        events.filter("is_start")
        .select("key", "t", "end_n", "end_min", "end_max", F.posexplode(edges).alias("edge", "shift"))
        .select("key", (F.col("t") + F.col("shift")).alias("at"), (F.col("edge") + 1).alias("i"), "end_n", "end_min", "end_max")
    )
    # A start shifted beyond the key's last end has all ends below it, one before the first has none.
    beyond = probes.filter(F.col("at") > F.col("end_max")).groupBy("i").agg(F.sum(F.col("end_n")).cast(WIDEST).alias("below"))
    within = probes.filter((F.col("at") > F.col("end_min")) & (F.col("at") <= F.col("end_max"))).select("key", "at", "i")

    # Copies at one place become one weighted row before they move. At one instant starts
    # come first: an end at the edge itself is not below it.
    rows = ends.unionByName(within).groupBy("key", "at", "i").agg(F.count(F.lit(1)).alias("weight"))
    rows = rows.withColumn("is_end", F.col("i") == 0)
    rows = ordered_slices(rows, ["key"], ["at", "is_end", "i"])
    running = Window.partitionBy("key", SLICE).orderBy("at", "is_end", "i")
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends_so_far = F.sum(F.when(F.col("is_end"), F.col("weight")).otherwise(0)).over(running)
    # Per slice of a key and edge: starts, and the ends of the slice below them.
    slices = (
        rows.withColumn("so_far", ends_so_far)
        .groupBy("key", SLICE, "i")
        .agg(
            F.sum(F.col("weight").cast(WIDE)).cast(WIDE).alias("weight"),
            F.sum((F.col("weight").cast(WIDE) * F.col("so_far")).cast(WIDEST)).cast(WIDEST).alias("inside"),
        )
    )
    before = Window.partitionBy("key").orderBy(SLICE).rangeBetween(Window.unboundedPreceding, -1)
    earlier = F.sum(F.when(F.col("i") == 0, F.col("weight"))).over(before)
    counted = (
        slices.withColumn("earlier", F.coalesce(earlier, F.lit(0)).cast(WIDE))
        .filter(F.col("i") > 0)
        .groupBy("i")
        .agg(F.sum((F.col("inside") + F.col("weight") * F.col("earlier")).cast(WIDEST)).cast(WIDEST).alias("below"))
    )
    return counted.unionByName(beyond).groupBy("i").agg(F.sum("below").cast(WIDEST).alias("below"))


def _between(below: DataFrame, bins: int, everything: Column) -> DataFrame:
    """(bin, count) from the pairs below each edge."""
    cumulative = below.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("i"))
    cumulative = cumulative.join(F.broadcast(below), "i", "left").select(  # one row per edge
        "i",
        F.when(F.col("i") == bins, everything)
        .otherwise(F.coalesce("below", F.lit(0)))
        .cast(WIDEST)
        .alias("below"),
    )
    up_to_next = F.lead("below").over(Window.orderBy("i"))
    return cumulative.select(
        F.col("i").alias("bin"), (up_to_next - F.col("below")).cast(WIDEST).alias("count")
    ).filter(F.col("bin") < bins)
