"""Projection, predicates and repair of incomplete records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)
# What a missing field becomes.
MISSING_NUMBER = 0
MISSING_TEXT = "unknown"
BLANKS = " \t\n\r\x0b\x0c"
# Times that mean before and after the trace.
BEFORE_TRACE = 0
AFTER_TRACE = 2**63 - 1


def _all(conditions: Iterable[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def require_nonempty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where a field is NULL or, for text, empty."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.filter(
        _all(F.col(c).isNotNull() & (F.col(c) != "") if c in text else F.col(c).isNotNull() for c in cols)
    )


def require_fields(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where a mandatory field is NULL."""
    return df.dropna(subset=list(cols))


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def events_of(df: DataFrame, code: int, column: str = "event_type") -> DataFrame:
    """Events of one type."""
    return df.filter(F.col(column) == code)


def events_in(df: DataFrame, codes: Sequence[int], column: str = "event_type") -> DataFrame:
    """Events whose type is one of ``codes``."""
    return df.filter(F.col(column).isin(list(codes)))


def positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every measure is present and above 0."""
    return df.filter(_all(F.col(c) > 0 for c in cols))


def valid_time(df: DataFrame, time: str = "time") -> DataFrame:
    """Records with an integer time; a malformed one is already NULL after a typed read."""
    return df.filter(F.col(time).try_cast("bigint").isNotNull())


def within_trace(df: DataFrame, time: str = "time") -> DataFrame:
    """Drop the marker times for before and after the trace."""
    return df.filter((F.col(time) > BEFORE_TRACE) & (F.col(time) < AFTER_TRACE))


def fill_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every field of ``schema``, with 0 for a missing or malformed number and
    ``unknown`` for missing text. Booleans stay NULL. Columns the schema does not
    name are kept as they are; fields the frame lacks count as missing."""
    have = set(df.columns)

    def filled(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in have else F.lit(None).cast("string")
        if isinstance(field.dataType, NUMBERS):
            value = F.coalesce(
                value.try_cast(field.dataType), F.lit(MISSING_NUMBER).cast(field.dataType)
            )
        elif isinstance(field.dataType, T.StringType):
            value = F.when(F.trim(value, F.lit(BLANKS)) != "", value).otherwise(MISSING_TEXT)
        else:
            value = value.try_cast(field.dataType)
        return value.alias(field.name)

    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*[filled(f) for f in schema], *extra)


def clean_with_account(
    df: DataFrame, schema: T.StructType, required: Sequence[str] = (), nonempty: Sequence[str] = ()
) -> tuple[DataFrame, Observation]:
    """Rows of text cleaned by the rules above, and what each rule did, counted in the same pass.

    In this order, a row is dropped for the first field of ``nonempty`` that is NULL or blank, then for
    the first of ``required`` that is NULL or, as a number, malformed. Of the rows kept, malformed
    numbers and booleans become NULL, and what is missing is filled as by ``fill_missing``. The account
    is there once the rows have been used; ``account_rows`` shows it. Fields the frame lacks count as
    missing."""
    have = set(df.columns)

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    def blank(name: str) -> Column:
        return F.coalesce(F.trim(text(name), F.lit(BLANKS)) == "", F.lit(True))

    def malformed(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.StringType):
            return F.lit(False)
        return ~blank(field.name) & F.trim(text(field.name), F.lit(BLANKS)).try_cast(field.dataType).isNull()

    by_name = {f.name: f for f in schema}
    dropped = [("nonempty", c, blank(c)) for c in nonempty]
    dropped += [("required", c, blank(c) | malformed(by_name[c]) if c in by_name else blank(c)) for c in required]
    first = F.lit(None).cast("int")
    for i, (_, _, fails) in reversed(list(enumerate(dropped))):
        first = F.when(fails, F.lit(i)).otherwise(first)
    verdict = "_first_rule"
    kept = F.col(verdict).isNull()
    counts = {f"dropped|{rule}|{c}": F.count_if(F.col(verdict) == i) for i, (rule, c, _) in enumerate(dropped)}
    for f in schema:
        if not isinstance(f.dataType, T.StringType):
            counts[f"nulled|malformed|{f.name}"] = F.count_if(kept & malformed(f))
        if not isinstance(f.dataType, T.BooleanType):
            counts[f"filled|missing|{f.name}"] = F.count_if(kept & (blank(f.name) | malformed(f)))
    account = Observation()
    seen = df.withColumn(verdict, first).observe(
        account, F.count(F.lit(1)).alias("read|all|"), *[c.alias(n) for n, c in counts.items()]
    )
    trimmed = [
        F.trim(F.col(c), F.lit(BLANKS)).alias(c) if c in by_name and not isinstance(by_name[c].dataType, T.StringType) else F.col(c)
        for c in df.columns
    ]
    return fill_missing(seen.filter(kept).select(*trimmed), schema), account


def account_rows(spark: SparkSession, account: Observation) -> DataFrame:
    """An account as rows (action, rule, field, rows); waits until the cleaned rows have been used."""
    rows = [(*name.split("|"), n) for name, n in account.get.items()]  # a row for each rule and field
    return spark.createDataFrame(rows, "action string, rule string, field string, rows long")
