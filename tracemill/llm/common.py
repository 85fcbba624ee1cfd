"""What the operators share: staged tables, text columns, words as arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import shared_folder

# Fixed patterns of the word definitions. ``SPACE`` divides at ASCII white space,
# ``NOT_WORD`` at every ASCII character but digits and letters.
SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    It cuts the lineage, and a lost executor costs a read and no second run."""
    path = shared_folder(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Remove what ``staged`` has written for these tables, once nothing reads them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def heavy_keys(many: DataFrame, key: str, share: int = 1000, least: int = 256) -> list:
    """The keys with more than one in ``share`` of the rows (and ``least`` rows): fewer than ``share`` of them."""
    limit = max(many.count() // share, least)
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return [row[0] for row in counts.where(F.col("n") > limit).select(key).collect()]


def salted_join(many: DataFrame, one: DataFrame, key: str, heavy: list, copies: int = 64) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key. The rows of the ``heavy`` keys are
    dealt over ``copies`` tasks; their row of ``one`` goes to each."""
    if not heavy:
        return many.join(one, key)
    salt, is_heavy = fresh("salt"), F.col(key).isin(heavy)
    dealt = F.pmod(F.xxhash64(*many.columns), F.lit(copies)).cast("int")
    many = many.withColumn(salt, F.when(is_heavy, dealt).otherwise(F.lit(0)))
    one = one.withColumn(salt, F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    return many.join(one, [key, salt]).drop(salt)


def joined_by_key(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """The same, with the heavy keys counted in ``many``, which should be a table."""
    return salted_join(many, one, key, heavy_keys(many, key))


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each combination of the first ``keys`` columns, which are long or int and lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *new.tolist(), batch.num_rows]
        if held and any(held[0].column(k)[0].as_py() != int(c[0]) for k, c in enumerate(columns)):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(bounds, bounds[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def whole_text(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column, separator: str = SPACE) -> Column:
    """The words between separators; none for an empty text."""
    return F.filter(F.split(text, separator), lambda w: w != F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    Unlike a column of its own, it also stays one when a filter is pushed below it."""
    return F.get(F.transform(F.array(value), use), 0)


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bound the bytes that one Arrow batch of long texts may hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")


def joined_sha256(strings: Column) -> Column:
    """Lowercase hex SHA-256 of the strings of an array, comma-joined."""
    return F.sha2(F.array_join(strings, ","), 256)
