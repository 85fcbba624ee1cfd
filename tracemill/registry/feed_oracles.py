"""SQL with the same rows as the queries of feeds, streams and stored forms."""

from __future__ import annotations

from tracemill.sources.catalog import FORMATS, TABLES

DELAYED = """, hops as (select g from range(5) t(g)),
arrived as (
  select j.*, date_trunc('second', make_timestamp(time)) as event_time,
    least((time - lo) * 12 // (hi - lo + 1) + case when event_id % 10 = 0 then 3 else 0 end, 11) as batch
  from job_events j, (select min(time) as lo, max(time) as hi from job_events)),
marks as (
  select b, (select max(event_time) from arrived where batch <= b - 2) - interval 5 minutes as behind from range(12) t(b)),
copies as (
  select a.*, date_trunc('minute', event_time) - g * interval 1 minute as window_start,
    date_trunc('minute', event_time) + (5 - g) * interval 1 minute as window_end,
    coalesce(date_trunc('minute', event_time) + (5 - g) * interval 1 minute <= behind, false) as closed
  from arrived a join marks on batch = b cross join hops),
lost as (
  select time, job_id, user, event_type, cast(count(*) as integer) as lost from copies where closed
  group by event_id, time, job_id, user, event_type)
select window_start, window_end, user, event_type, count(*) as event_count, cast(null as bigint) as time,
  cast(null as bigint) as job_id, cast(null as integer) as lost, (select cast(sum(lost) as bigint) from lost) as dropped
from copies where not closed group by window_start, window_end, user, event_type
union all by name
select time, job_id, user, event_type, lost, (select cast(sum(lost) as bigint) from lost) as dropped from lost"""

BROKEN = """, told as (
  select *, case when event_id % 17 = 0 then left('{"time":' || time, 12)
      when event_id % 19 = 0 then 'not json ' || event_id
      when event_id % 23 = 0 then '{"time":"soon","job_id":' || job_id || '}'
      when event_id % 29 = 0 then '' end as raw
  from job_events)
select case when raw is null then time end as time, missing_info, case when raw is null then job_id end as job_id,
  case when raw is null then event_type end as event_type, case when raw is null then user end as user,
  case when raw is null then scheduling_class end as scheduling_class,
  case when raw is null then job_name end as job_name, logical_job_name, raw is not null as broken, raw
from told"""

KEPT = "event_id % 7 <> 0 and event_id % 13 <> 0"
ACCOUNT = f"""select 'read' as action, 'all' as rule, '' as field, count(*) as rows from job_events
union all select 'dropped', 'nonempty', 'user', count(*) filter (event_id % 7 = 0) from job_events
union all select 'dropped', 'required', 'time', count(*) filter (event_id % 7 <> 0 and event_id % 13 = 0) from job_events
union all select 'dropped', 'required', unnest(['job_id', 'event_type']), 0
union all select 'nulled', 'malformed', unnest(['time', 'missing_info', 'job_id', 'event_type']), 0
union all select 'nulled', 'malformed', 'scheduling_class', count(*) filter ({KEPT} and event_id % 11 = 0) from job_events
union all select 'filled', 'missing', unnest(['time', 'job_id', 'event_type', 'user', 'job_name']), 0
union all select 'filled', 'missing', unnest(['missing_info', 'logical_job_name']), (select count(*) filter ({KEPT}) from job_events)
union all select 'filled', 'missing', 'scheduling_class', count(*) filter ({KEPT} and event_id % 11 = 0) from job_events"""

OTHER_TABLES = """, machine_attributes as (
  select epoch_us(ts) as time, user_id as machine_id, 'attribute-' || (event_id % 3) as attribute_name,
    event_type as attribute_value, event_id % 5 = 0 as attribute_deleted from events),
task_constraints as (
  select epoch_us(ts) as time, event_id - event_id % 5 as job_id, event_id % 2 as task_index,
    event_id % 4 as comparison_operator, 'attribute-' || (event_id % 3) as attribute_name,
    case when event_id % 7 <> 0 then cast(user_id as varchar) end as attribute_value from events)
"""


def _coverage() -> str:
    return OTHER_TABLES + " union all ".join(
        f"""select '{name}' as "table", cast({i} as integer) as position, '{field}' as field, '{FORMATS[fmt].simpleString()}' as type,
  {mandatory} as mandatory, count({field}) as present, count(*) - count({field}) as absent from {name}"""
        for name, fields in TABLES.items()
        for i, (field, fmt, mandatory) in enumerate(fields, 1)
    )


def feed_oracles(trace: str, windows, usage: str, counts: str, known: dict[str, str]) -> dict[str, str]:
    """``trace`` has the trace tables, ``windows`` makes events with their minutes, ``usage`` and ``counts`` are
    hopping windows, and ``known`` has the SQL of the other queries."""
    behind = "(select max(event_time) - interval 5 minutes from timed)"
    held = "select count(distinct window_end) as windows, count(*) as groups, {flag} as watermark from held"
    open_ = windows("job_events") + f", held as (select window_end from ({counts}))"
    return {
        "late_rows": trace + DELAYED,
        "broken_records": trace + BROKEN,
        "rule_accounts": trace + ACCOUNT,
        "closed_usage_stream": windows("filled") + f"select * from ({usage}) where window_end <= {behind}",
        "open_windows": open_
        + f", later as (select window_end from held where window_end > {behind}) "
        + held.format(flag="false")
        + " union all "
        + held.format(flag="true").replace("from held", "from later"),
        "console_stream": "select count(*) as rows_read from events",
        "catalogue_coverage": trace + _coverage(),
        "replay_merged_parts": known["replay_order_check"],
        "job_locality_converted": known["job_locality"],
        "scheduling_latency_converted": known["scheduling_latency"],
        "job_durations_converted": known["job_durations"],
        "request_vs_usage_converted": known["request_vs_usage"],
        "stored_distincts": trace
        + """select event_type, count(distinct user) as users, true as within_3_percent
from job_events where (time // 3600000000) % 2 = 0 group by all""",
        "every_pair": trace
        + """select s.job_id, e.time - s.time as elapsed
from job_events s join job_events e on s.job_id = e.job_id and s.event_type = 0 and e.event_type = 1""",
    }
