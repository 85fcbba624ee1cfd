"""Slices of ordered groups: no group has to fit one task.

A window over a key sorts the whole key in one task. Here rows are first dealt out by
ranges of key and order together, so a hot key, a hot instant and ties in any column
spread over as many tasks as they need. What crosses a slice is found from the first and
last row of each slice of a key, a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = "_slice"


def ordered_slices(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_slice``, a number that rises along ``order`` within each ``part``.

    Rows that agree in all of these columns are in one slice; nothing else has to be.
    """
    return df.repartitionByRange(*part, *order).withColumn(SLICE, F.spark_partition_id())
