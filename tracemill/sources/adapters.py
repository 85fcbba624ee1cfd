"""The given ``events`` table in the shape of the trace tables.

Holds for a session in UTC, since the table's times carry no zone.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.catalog import TABLES

# Event types of the table as event codes.
JOB_CODES = {"signup": 0, "click": 1, "error": 2, "purchase": 4}
OTHER_JOB_CODE = 5
MACHINE_CODES = {"signup": 0, "error": 1}
OTHER_MACHINE_CODE = 2
USAGE_PERIOD = 300_000_000  # microseconds


def _code(codes: dict[str, int], other: int) -> Column:
    cases = " ".join(f"when '{name}' then {code}L" for name, code in codes.items())
    return F.expr(f"case event_type {cases} else {other}L end")


class Trace:
    """Trace tables derived from one ``events`` table; ``event_id`` is the tie-break of all."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.events = spark.read.parquet(f"{folder}/events.parquet")

    def _columns(self) -> dict[str, Column]:
        user_id = F.col("user_id")
        return {
            "time": F.expr("unix_micros(cast(ts as timestamp))"),
            "missing_info": F.lit(None).cast("long"),
            "job_id": F.expr("event_id - event_id % 5"),
            "task_index": F.expr("event_id % 2"),
            "machine_id": F.expr("case when event_type <> 'view' then user_id end"),
            "event_type": _code(JOB_CODES, OTHER_JOB_CODE),
            "user": F.expr("'user-' || user_id"),
            "scheduling_class": F.expr("case when event_id % 13 <> 0 then user_id % 4 end"),
            "priority": user_id % 12,
            "job_name": F.expr("'job-' || (event_id - event_id % 5)"),
            "logical_job_name": F.lit(None).cast("string"),
            "cpu_request": F.expr("value / 500"),
            "memory_request": F.get_json_object("props", "$.k").try_cast("double") / 100,
            "disk_space_request": F.lit(None).cast("double"),
            "different_machines_restriction": F.expr("event_id % 3 = 0"),
            "event_id": F.col("event_id"),
        }

    def _select(self, names: list[str], **other: Column) -> DataFrame:
        columns = {**self._columns(), **other}
        return self.events.select(*[columns[n].alias(n) for n in names])

    @cached_property
    def job_events(self) -> DataFrame:
        return self._select([f for f, *_ in TABLES["job_events"]] + ["event_id"])

    @cached_property
    def task_events(self) -> DataFrame:
        return self._select([f for f, *_ in TABLES["task_events"]] + ["event_id"])

    @cached_property
    def machine_events(self) -> DataFrame:
        return self._select(
            [f for f, *_ in TABLES["machine_events"]] + ["event_id"],
            machine_id=F.col("user_id"),
            event_type=_code(MACHINE_CODES, OTHER_MACHINE_CODE),
            platform_id=F.expr("'platform-' || (user_id % 3)"),
            cpus=F.expr("case when event_id % 17 <> 0 then (user_id % 4 + 1) * 0.25D end"),
            memory=self._columns()["memory_request"],
        )

    @cached_property
    def task_usage(self) -> DataFrame:
        """Usage comes from other columns than the requests, so that the two sides differ."""
        time, k = self._columns()["time"], F.get_json_object("props", "$.k").try_cast("double")
        start_time = time - time % USAGE_PERIOD
        value, user = F.col("value"), F.col("user_id")
        return self._select(
            [f for f, *_ in TABLES["task_usage"]] + ["event_id"],
            start_time=start_time,
            end_time=start_time + USAGE_PERIOD,
            cpu_rate=k / 100,
            canonical_memory_usage=value / 500,
            assigned_memory_usage=value / 250,
            unmapped_page_cache=F.lit(None).cast("double"),
            total_page_cache=k / 50,
            maximum_memory_usage=value / 400,
            disk_io_time=user / 8,
            local_disk_space_usage=k / 200,
            maximum_cpu_rate=k / 25,
            maximum_disk_io_time=user / 4,
            cycles_per_instruction=F.lit(None).cast("double"),
            memory_accesses_per_instruction=F.lit(None).cast("double"),
            sample_portion=F.lit(1.0),
            aggregation_type=F.expr("event_id % 2 = 0"),
            sampled_cpu_usage=k / 400,
        )

    @cached_property
    def machine_attributes(self) -> DataFrame:
        return self._select(
            [f for f, *_ in TABLES["machine_attributes"]] + ["event_id"],
            machine_id=F.col("user_id"),
            attribute_name=F.expr("'attribute-' || (event_id % 3)"),
            attribute_value=F.col("event_type"),
            attribute_deleted=F.expr("event_id % 5 = 0"),
        )

    @cached_property
    def task_constraints(self) -> DataFrame:
        return self._select(
            [f for f, *_ in TABLES["task_constraints"]] + ["event_id"],
            comparison_operator=F.expr("event_id % 4"),
            attribute_name=F.expr("'attribute-' || (event_id % 3)"),
            attribute_value=F.expr("case when event_id % 7 <> 0 then cast(user_id as string) end"),
        )
