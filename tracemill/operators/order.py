"""Ordered results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def sorted_by(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows in ascending order of the key."""
    return df.orderBy(*([key] if isinstance(key, str) else key))


def first_n(df: DataFrame, order: Sequence[Column | str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in the given order; each task keeps at most ``n``."""
    return df.orderBy(*order).limit(n)
