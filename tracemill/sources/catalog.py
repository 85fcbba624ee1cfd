"""The six trace tables: field names, types, mandatory flags; event codes and topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields in file order as (name, format, mandatory).
TABLES = {
    "job_events": (
        ("time", "INTEGER", True),
        ("missing_info", "INTEGER", False),
        ("job_id", "INTEGER", True),
        ("event_type", "INTEGER", True),
        ("user", "STRING_HASH", False),
        ("scheduling_class", "INTEGER", False),
        ("job_name", "STRING_HASH", False),
        ("logical_job_name", "STRING_HASH", False),
    ),
    "task_events": (
        ("time", "INTEGER", True),
        ("missing_info", "INTEGER", False),
        ("job_id", "INTEGER", True),
        ("task_index", "INTEGER", True),
        ("machine_id", "INTEGER", False),
        ("event_type", "INTEGER", True),
        ("user", "STRING_HASH", False),
        ("scheduling_class", "INTEGER", False),
        ("priority", "INTEGER", True),
        ("cpu_request", "FLOAT", False),
        ("memory_request", "FLOAT", False),
        ("disk_space_request", "FLOAT", False),
        ("different_machines_restriction", "BOOLEAN", False),
    ),
    "machine_events": (
        ("time", "INTEGER", True),
        ("machine_id", "INTEGER", True),
        ("event_type", "INTEGER", True),
        ("platform_id", "STRING_HASH", False),
        ("cpus", "FLOAT", False),
        ("memory", "FLOAT", False),
    ),
    "machine_attributes": (
        ("time", "INTEGER", True),
        ("machine_id", "INTEGER", True),
        ("attribute_name", "STRING_HASH", True),
        ("attribute_value", "STRING_HASH_OR_INTEGER", False),
        ("attribute_deleted", "BOOLEAN", True),
    ),
    "task_constraints": (
        ("time", "INTEGER", True),
        ("job_id", "INTEGER", True),
        ("task_index", "INTEGER", True),
        ("comparison_operator", "INTEGER", True),
        ("attribute_name", "STRING_HASH", True),
        ("attribute_value", "STRING_HASH_OR_INTEGER", False),
    ),
    "task_usage": (
        ("start_time", "INTEGER", True),
        ("end_time", "INTEGER", True),
        ("job_id", "INTEGER", True),
        ("task_index", "INTEGER", True),
        ("machine_id", "INTEGER", True),
        ("cpu_rate", "FLOAT", False),
        ("canonical_memory_usage", "FLOAT", False),
        ("assigned_memory_usage", "FLOAT", False),
        ("unmapped_page_cache", "FLOAT", False),
        ("total_page_cache", "FLOAT", False),
        ("maximum_memory_usage", "FLOAT", False),
        ("disk_io_time", "FLOAT", False),
        ("local_disk_space_usage", "FLOAT", False),
        ("maximum_cpu_rate", "FLOAT", False),
        ("maximum_disk_io_time", "FLOAT", False),
        ("cycles_per_instruction", "FLOAT", False),
        ("memory_accesses_per_instruction", "FLOAT", False),
        ("sample_portion", "FLOAT", False),
        ("aggregation_type", "BOOLEAN", False),
        ("sampled_cpu_usage", "FLOAT", False),
    ),
}

# How a converted table lies: the columns that deal it into buckets, and its order within.
LAYOUT = {
    "job_events": (["job_id"], ["job_id", "time"]),
    "task_events": (["job_id", "task_index"], ["job_id", "task_index", "time"]),
    "task_usage": (["job_id", "task_index"], ["job_id", "task_index", "start_time"]),
    "task_constraints": (["job_id", "task_index"], ["job_id", "task_index", "time"]),
    "machine_events": (["machine_id"], ["machine_id", "time"]),
    "machine_attributes": (["machine_id"], ["machine_id", "time"]),
}

# Ids exceed 32 bits, so every integer is a long.
FORMATS = {
    "INTEGER": T.LongType(),
    "FLOAT": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "STRING_HASH": T.StringType(),
    "STRING_HASH_OR_INTEGER": T.StringType(),
}

# Event codes of machine_events.
MACHINE_ADD = 0
MACHINE_REMOVE = 1

# Event codes of job_events and task_events.
SUBMIT = 0
SCHEDULE = 1
EVICT = 2
FINISH = 4

# Topics and their partition count.
JOB_TOPIC = "job-events"
TASK_TOPIC = "task-events"
TOPIC_PARTITIONS = 12


def table_schema(name: str) -> T.StructType:
    """Typed schema of a trace table; the mandatory flag is field metadata,
    because a file read makes every column nullable anyway."""
    return T.StructType(
        [
            T.StructField(field, FORMATS[fmt], True, {"mandatory": mandatory})
            for field, fmt, mandatory in TABLES[name]
        ]
    )


def mandatory_fields(name: str) -> list[str]:
    return [field for field, _, mandatory in TABLES[name] if mandatory]


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """The catalogue held against tables: table, position, field, type, mandatory, and how many of its rows
    have the field and how many lack it. One pass over each table."""

    def of_table(name: str, df: DataFrame) -> DataFrame:
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f).alias(f) for f, *_ in TABLES[name]])
        fields = [
            F.struct(
                F.lit(i).alias("position"), F.lit(f).alias("field"), F.lit(FORMATS[fmt].simpleString()).alias("type"),
                F.lit(mandatory).alias("mandatory"), F.col(f).alias("present"), (F.col("rows") - F.col(f)).alias("absent"),
            )
            for i, (f, fmt, mandatory) in enumerate(TABLES[name], 1)
        ]
        return counts.select(F.lit(name).alias("table"), F.inline(F.array(*fields)))

    return reduce(DataFrame.unionByName, [of_table(name, df) for name, df in tables.items()])
