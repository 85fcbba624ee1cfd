"""Mixing sources to target weights by Poisson replication.

A source with target share w of the mix and n of the documents has the mean repetition
rate w * total / n. Each document's count is drawn by inverting the Poisson distribution
with that mean at a number in [0, 1) that a hash of seed and document id gives, so a task
that runs again draws the same. The document is repeated that often, and all copies are
shuffled by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, staged

SEED = "mix-1"
TEMPERATURE = 0.5  # weights are counts to this power
PART = 64  # a larger mean is the sum of draws with equal smaller means
BROADCAST_SOURCES = 100_000
SALTS = 64
BITS = 52


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that follows from the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") / float(1 << BITS)


def _cumulative(mean: Column) -> Column:
    """Cumulative Poisson probabilities from 0 on, far enough that the rest is below rounding."""
    most = (F.ceil(mean + 12 * F.sqrt(mean)) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["all"], F.array(s["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["all"]


def source_rates(docs: DataFrame, source: str = "source", weights: dict | None = None, total: float | None = None,
                 temperature: float = TEMPERATURE) -> DataFrame:
    """Per source: documents, weight, and mean repetitions; without ``weights`` from the counts.

    ``weights`` are relative; sources not named have weight 0. The mix has ``total``
    documents on average, by default as many as there are."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (str(kv[0]), float(kv[1]))])
        weight = F.coalesce(F.try_element_at(named, F.col("source").cast("string")), F.lit(0.0))
    counts = staged(counts.withColumn("weight", weight), "source-counts")
    documents, all_weights = counts.agg(F.sum("n"), F.sum("weight")).first()
    size = float(documents or 0) if total is None else float(total)
    share = F.col("weight") / F.lit(all_weights or 1.0)
    return counts.withColumn("rate", share * F.lit(size) / F.col("n"))


def mix_sources(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None,
                total: float | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated by its draw, in shuffled order, with ``copy`` from 1 on and ``mix_key``.

    Rows are ordered by ``mix_key`` within partitions that a hash of it and of the row deals out, so
    rows that share an id, and equal rows, spread too. Rows with equal ids draw equal counts; a row without an id draws by a hash of its other columns,
    so only exact copies without an id draw alike. A null source is a source of its own. Columns stay as they are, ones named ``copy`` or ``mix_key`` are
    replaced; texts are not looked at. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, source, weights, total, temperature)
    mean, parts, steps, salt = fresh("mean"), fresh("parts"), fresh("steps"), fresh("salt")
    own = fresh("source")
    rates = rates.select(F.col("source").alias(own), "rate")
    rates = rates.withColumn(parts, F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    rates = rates.withColumn(mean, F.col("rate") / F.col(parts))
    rates = rates.select(own, parts, _cumulative(F.col(mean)).alias(steps))
    kept = [c for c in docs.columns if c not in ("copy", "mix_key")]
    name = fresh("name")
    others = F.concat(F.lit("null:"), F.md5(F.to_json(F.struct(*[c for c in kept if c != key]))))
    rows = docs.select(*kept, F.coalesce(F.col(key).cast("string"), others).alias(name))
    same = rows[source].eqNullSafe(rates[own])
    if rates.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), same)
    else:  # a hot source is in SALTS groups
        rates = rates.withColumn(salt + "r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
        rows = rows.join(rates, rows[source].eqNullSafe(rates[own]) & (rows[salt] == rates[salt + "r"]))
    draw = lambda j: F.size(F.filter(steps, lambda c: c <= _unit(F.lit(seed), F.col(name), j.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(0), F.col(parts) - 1), F.lit(0), lambda s, j: s + draw(j))
    drawn = fresh("count")
    rows = rows.withColumn(drawn, count).where(F.col(drawn) > 0)
    rows = rows.select(*kept, name, F.explode(F.sequence(F.lit(1), F.col(drawn))).alias("copy"))
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.col(name), F.col("copy").cast("string"), F.lit("order"))))
    # Rows of one id have one key a copy, so they are dealt out by all their columns, equal ones by the task that reads them.
    dealt = fresh("dealt")
    rows = rows.withColumn(dealt, F.xxhash64("mix_key", *[c for c in kept if c != key], F.spark_partition_id())).drop(name)
    return rows.repartition(dealt).drop(dealt).sortWithinPartitions("mix_key")


def op8_mix_sources(docs: DataFrame) -> DataFrame:
    return mix_sources(docs)


ORACLE_SQL = f"""
with counts as (select source, count(*) n from documents group by source),
rates as (
  select source, sqrt(n) / (select sum(sqrt(n)) from counts) * (select sum(n) from counts) / n rate from counts),
parted as (select source, greatest(ceil(rate / {PART}), 1) parts, rate / greatest(ceil(rate / {PART}), 1) mean from rates),
steps as (
  select source, parts, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) over (partition by source order by k) below
  from parted, range(0, 200) r(k)),
draws as (
  select doc_id, source, j,
    ('0x' || md5('{SEED}:' || doc_id || ':' || j)[1:{BITS // 4}])::bigint / {1 << BITS}.0::double u
  from documents join parted using (source), range(0, 64) t(j) where j < parts),
counted as (
  select d.doc_id, count(s.k) n from draws d left join steps s on s.source = d.source and s.below <= d.u
  group by d.doc_id)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, c::int "copy",
  md5('{SEED}:' || d.doc_id || ':' || c || ':order') mix_key
from documents d join counted using (doc_id), range(1, 400) t(c) where c <= counted.n
"""
