"""SQL over the given tables with the same rows as the registered queries."""

from __future__ import annotations

from tracemill.registry.feed_oracles import feed_oracles

TRACE = """
with job_events as (
  select epoch_us(ts) as time, cast(null as bigint) as missing_info,
    event_id - event_id % 5 as job_id,
    cast(case event_type when 'signup' then 0 when 'click' then 1 when 'error' then 2
      when 'purchase' then 4 else 5 end as bigint) as event_type,
    'user-' || user_id as user,
    case when event_id % 13 <> 0 then user_id % 4 end as scheduling_class,
    'job-' || (event_id - event_id % 5) as job_name,
    cast(null as varchar) as logical_job_name, event_id
  from events),
task_events as (
  select j.time, j.missing_info, j.job_id, event_id % 2 as task_index,
    case when e.event_type <> 'view' then user_id end as machine_id,
    j.event_type, j.user, j.scheduling_class, user_id % 12 as priority,
    value / 500 as cpu_request,
    cast(json_extract_string(props, '$.k') as double) / 100 as memory_request,
    cast(null as double) as disk_space_request,
    event_id % 3 = 0 as different_machines_restriction, event_id
  from events e join job_events j using (event_id)),
machine_events as (
  select epoch_us(ts) as time, user_id as machine_id,
    cast(case event_type when 'signup' then 0 when 'error' then 1 else 2 end as bigint) as event_type,
    'platform-' || (user_id % 3) as platform_id,
    case when event_id % 17 <> 0 then 0.25e0 * (user_id % 4 + 1) end as cpus,
    cast(json_extract_string(props, '$.k') as double) / 100 as memory, event_id
  from events),
task_usage as (
  select t.time - t.time % 300000000 as start_time, t.time - t.time % 300000000 + 300000000 as end_time,
    t.job_id, t.task_index, t.machine_id,
    k / 100 as cpu_rate, value / 500 as canonical_memory_usage, value / 250 as assigned_memory_usage,
    cast(null as double) as unmapped_page_cache, k / 50 as total_page_cache, value / 400 as maximum_memory_usage,
    user_id / 8 as disk_io_time, k / 200 as local_disk_space_usage, k / 25 as maximum_cpu_rate,
    user_id / 4 as maximum_disk_io_time, cast(null as double) as cycles_per_instruction,
    cast(null as double) as memory_accesses_per_instruction, 1e0 as sample_portion,
    event_id % 2 = 0 as aggregation_type, k / 400 as sampled_cpu_usage, event_id
  from (select *, cast(json_extract_string(props, '$.k') as double) as k from events) join task_events t using (event_id))
"""

UNION = """, all_events as (
  select *, 0 as topic_rank from job_events union all by name select *, 1 as topic_rank from task_events)
"""

# The fields of a record after missing ones are filled; a job's record has no task fields.
RECORD = """time, coalesce(missing_info, 0) as missing_info, job_id, task_index,
  case topic_rank when 1 then coalesce(machine_id, 0) end as machine_id, event_type, user,
  coalesce(scheduling_class, 0) as scheduling_class, priority,
  round(cpu_request, 9) as cpu_request, round(memory_request, 9) as memory_request,
  case topic_rank when 1 then coalesce(disk_space_request, 0) end as disk_space_request,
  different_machines_restriction"""
JOB_FIELDS = """case topic_rank when 0 then coalesce(job_name, 'unknown') end as job_name,
  case topic_rank when 0 then 'unknown' end as logical_job_name"""
ROUTED = """case topic_rank when 0 then 'job-events' else 'task-events' end as topic,
  cast(time % 12 as integer) as partition, cast(job_id as varchar) as key"""
SHOWN = "* replace (round(cpu_request, 9) as cpu_request, round(memory_request, 9) as memory_request)"

# Windows by start: the minute of the event, and for hopping windows the four before it.
MINUTES = """, hops as (select g from range(5) t(g)),
timed as (
  select *, date_trunc('second', make_timestamp(time)) as event_time,
    date_trunc('minute', make_timestamp(time)) as minute
  from {source})
"""

HOPPING_USAGE = """
select minute - g * interval 1 minute as window_start, minute + (5 - g) * interval 1 minute as window_end,
  machine_id, round(sum(cpu_request), 9) as total_cpu_usage, round(sum(memory_request), 9) as total_memory_usage,
  round(avg(cpu_request), 9) as avg_cpu_request_per_task,
  round(avg(memory_request), 9) as avg_memory_request_per_task
from timed cross join hops group by all
"""

HOPPING_COUNTS = """
select minute - g * interval 1 minute as window_start, minute + (5 - g) * interval 1 minute as window_end,
  user, event_type, count(*) as event_count
from timed cross join hops group by all
"""

MACHINE_TOTALS = """, totals as (
  select minute as window_start, minute + interval 1 minute as window_end, machine_id,
    sum(cpu_request) as total_cpu_usage, sum(memory_request) as total_memory_usage
  from timed group by all)
"""

# The feed replaces a missing machine by 0.
FILLED = ", filled as (select * replace (coalesce(machine_id, 0) as machine_id) from task_events)"


def _windows(source: str) -> str:
    return TRACE + (FILLED if source == "filled" else "") + MINUTES.format(source=source)


def _pairs(start: int, end: int, first_only: bool = False) -> str:
    """Every start of a job with every end, or the first of each."""
    source = "job_events"
    extra = ""
    if first_only:
        source = "firsts"
        extra = ", firsts as (select job_id, event_type, min(time) as time from job_events group by all)"
    return (
        TRACE
        + extra
        + f""", pairs as (
  select s.job_id, e.time - s.time as elapsed
  from {source} s join {source} e on s.job_id = e.job_id and s.event_type = {start} and e.event_type = {end})
"""
    )


PAIR_TOTALS = """select job_id, count(*) as pairs, cast(sum(elapsed) as bigint) as total,
  min(elapsed) as shortest, max(elapsed) as longest from pairs group by all"""

DURATIONS = """, b as (select min(elapsed) as lo, max(elapsed) - min(elapsed) as span from pairs),
c as (
  select least((elapsed - lo) * 50 // span, 49) as bin, count(*) as n from pairs, b group by all)
select cast(g as integer) as bin, round(lo / 1e6 + g * (span / 1e6 / 50), 7) as bin_start,
  round(lo / 1e6 + (g + 1) * (span / 1e6 / 50), 7) as bin_end, coalesce(n, 0) as count
from range(50) t(g) cross join b left join c on g = bin"""

# Every event as one of three jobs.
FEW_JOBS = """, few as (select user_id % 3 as job_id, j.time, j.event_type from events e join job_events j using (event_id)),
pairs as (
  select s.job_id, e.time - s.time as elapsed
  from few s join few e on s.job_id = e.job_id and s.event_type = {start} and e.event_type = {end})
"""


def _mean(name: str) -> str:
    return f"""select count(*) as pairs, round(avg(elapsed) / 1e6, 9) as {name},
  round(avg(elapsed) / 1e6 * 2, 9) as threshold_seconds from pairs"""


def _outliers(name: str) -> str:
    return f"""select job_id, round(elapsed / 1e6, 9) as {name} from pairs
where elapsed > 2 * (select avg(elapsed) from pairs) order by elapsed desc, job_id limit 10"""


PEAKS = """, instants as (
  select machine_id, start_time, sum(coalesce(cpu_rate, 0)) as cpu_usage,
    sum(coalesce(canonical_memory_usage, 0)) as memory_usage
  from task_usage where machine_id is not null group by all),
peaks as (
  select machine_id, max(cpu_usage) as max_cpu_usage, max(memory_usage) as max_memory_usage
  from instants group by all),
evictions as (
  select machine_id, count(*) as eviction_count from task_events
  where event_type = 2 and machine_id is not null group by all)
"""

CORRELATIONS = """
select round(case when isnan(corr(eviction_count, max_cpu_usage)) then null
    else corr(eviction_count, max_cpu_usage) end, 9) as cpu_correlation,
  round(case when isnan(corr(eviction_count, max_memory_usage)) then null
    else corr(eviction_count, max_memory_usage) end, 9) as memory_correlation
from machines
"""

REQUESTS = """, requests as (
  select time, job_id, task_index, cpu_request, memory_request from task_events
  where cpu_request > 0 and memory_request > 0),
first_requests as (
  select job_id, task_index, cpu_request, memory_request from requests
  qualify row_number() over (partition by job_id, task_index order by time, cpu_request, memory_request) = 1),
samples as (
  select job_id, task_index, cpu_rate as cpu_usage, canonical_memory_usage as memory_usage from task_usage
  where cpu_rate > 0 and canonical_memory_usage > 0)
"""


def _request_correlation(source: str) -> str:
    return (
        TRACE
        + REQUESTS
        + f"""select count(*) as pairs, round(corr(cpu_request, cpu_usage), 9) as cpu_correlation,
  round(corr(memory_request, memory_usage), 9) as memory_correlation
from {source} join samples using (job_id, task_index)"""
    )


def _neighbours(part: str, source: str) -> str:
    return TRACE + f""", neighbours as (
  select *, lead(event_type) over w as next_type, lead(time) over w as next_time
  from {source} window w as (partition by {part} order by time, event_id))
"""


def _class_counts(source: str, counted: str, name: str) -> str:
    return TRACE + f"""select scheduling_class, {counted} as {name} from {source}
where scheduling_class is not null group by all"""


EVICTION_SHARE = TRACE + """select scheduling_class,
  round(count(*) filter (event_type = 2) / count(*), 9) as eviction_probability
from task_events where scheduling_class is not null group by all"""

SUBMIT_TIMES = """select *, time // 3600000000 as hour from job_events where event_type in (0, 1)"""


def _latency_by_hour(part: str) -> str:
    return (
        TRACE
        + f""", hours as ({SUBMIT_TIMES}), neighbours as (
  select *, lead(event_type) over w as next_type, lead(time) over w as next_time
  from hours window w as (partition by {part} order by time, event_id))
select hour, round(avg(next_time - time) / 1e6, 9) as mean_latency_seconds
from neighbours where event_type = 0 and next_type = 1 group by all"""
    )


def _scan(name: str, columns: str) -> str:
    return TRACE + f"select {columns} from {name}"


JOB_JSON = """'{"time":' || time || ',"job_id":' || job_id || ',"event_type":' || event_type
  || ',"user":"' || user || '"' || coalesce(',"scheduling_class":' || scheduling_class, '')
  || ',"job_name":"' || job_name || '"}'"""


def all_oracles() -> dict[str, str]:
    found = table_oracles()
    return found | feed_oracles(TRACE, _windows, HOPPING_USAGE, HOPPING_COUNTS, found)


def table_oracles() -> dict[str, str]:
    return {
        "scan_job_events": _scan(
            "job_events",
            "time, missing_info, job_id, event_type, user, scheduling_class, job_name, logical_job_name",
        ),
        "scan_task_events": _scan(
            "task_events",
            """time, missing_info, job_id, task_index, machine_id, event_type, user, scheduling_class,
  priority, round(cpu_request, 9) as cpu_request, round(memory_request, 9) as memory_request,
  disk_space_request, different_machines_restriction""",
        ),
        "scan_machine_events": _scan(
            "machine_events",
            "time, machine_id, event_type, platform_id, round(cpus, 9) as cpus, round(memory, 9) as memory",
        ),
        "decode_json_props": "select cast(json_extract_string(props, '$.k') as bigint) as k from events",
        "encode_events": TRACE
        + f"select cast(job_id as varchar) as key, {JOB_JSON} as value, event_id from job_events",
        "scan_task_usage": _scan(
            "task_usage",
            "* exclude (event_id) replace (" + ", ".join(
                f"round({c}, 9) as {c}" for c in
                """cpu_rate canonical_memory_usage assigned_memory_usage total_page_cache maximum_memory_usage disk_io_time
                local_disk_space_usage maximum_cpu_rate maximum_disk_io_time sampled_cpu_usage""".split()
            ) + ")",
        ),
        "scan_machine_attributes": """select epoch_us(ts) as time, user_id as machine_id,
  'attribute-' || (event_id % 3) as attribute_name, event_type as attribute_value,
  event_id % 5 = 0 as attribute_deleted from events""",
        "scan_task_constraints": """select epoch_us(ts) as time, event_id - event_id % 5 as job_id,
  event_id % 2 as task_index, event_id % 4 as comparison_operator, 'attribute-' || (event_id % 3) as attribute_name,
  case when event_id % 7 <> 0 then cast(user_id as varchar) end as attribute_value from events""",
        "scan_places": "select count(*) as rows, count(*) as places, 0::bigint as out_of_order from events",
        "route_events": TRACE + UNION + f"select {ROUTED}, event_id, {RECORD}, {JOB_FIELDS} from all_events",
        "read_topic": TRACE + UNION + f"select {RECORD} from all_events where topic_rank = 1",
        "metric_range": _windows("task_events")
        + MACHINE_TOTALS
        + """select 'spark_job_metrics' as job, 'total_cpu_usage' as metric,
  cast(machine_id as varchar) as machine_id, round(total_cpu_usage, 9) as value, window_end
from totals where total_cpu_usage is not null
  and window_end >= (select max(window_end) from totals) - interval 5 minutes""",
        "require_nonempty": TRACE
        + """select event_id, scheduling_class, user from job_events
where scheduling_class is not null and user is not null and user <> ''""",
        "require_fields": TRACE
        + """select event_id, job_id, machine_id from task_events
where job_id is not null and machine_id is not null""",
        "events_of": TRACE + "select event_id, time, machine_id from task_events where event_type = 2",
        "events_in": TRACE + "select event_id, time, event_type from job_events where event_type in (0, 1)",
        "positive": """select l_orderkey, l_linenumber, round(l_discount, 9) as l_discount, round(l_tax, 9) as l_tax
from lineitem where l_discount > 0 and l_tax > 0""",
        "fill_missing": TRACE
        + """select event_id,
  case when event_id % 7 = 0 then 0 else time end as time, 0::bigint as missing_info,
  case when event_id % 7 = 0 then 0 else job_id end as job_id,
  case when event_id % 7 = 0 then 0 else event_type end as event_type,
  case when event_id % 7 = 0 then 'unknown' else user end as user,
  case when event_id % 7 = 0 then 0 else coalesce(scheduling_class, 0) end as scheduling_class,
  case when event_id % 7 = 0 then 'unknown' else job_name end as job_name,
  'unknown' as logical_job_name from job_events""",
        "event_time": _windows("job_events") + "select event_id, event_time from timed",
        "scalar_functions": _windows("task_events")
        + """select event_id, round(time / 1e6, 6) as seconds, time // 3600000000 as hour, event_time,
  case when event_id % 11 <> 0 then machine_id end as machine,
  cast(case when event_id % 11 <> 0 then coalesce(machine_id, 0) else 0 end as double) as machine_or_zero,
  round(case when memory_request <> 0 then cpu_request / memory_request end, 12) as ratio,
  round(cpu_request / 2 * 100, 9) as pct from timed""",
        "eviction_by_machine_join": TRACE
        + PEAKS
        + """select machine_id, eviction_count, round(max_cpu_usage, 9) as max_cpu_usage,
  round(max_memory_usage, 9) as max_memory_usage from peaks join evictions using (machine_id)""",
        "join_counts_left": TRACE
        + PEAKS
        + """select machine_id, eviction_count, round(max_cpu_usage, 9) as max_cpu_usage,
  round(max_memory_usage, 9) as max_memory_usage from peaks left join evictions using (machine_id)""",
        "request_usage_join": TRACE
        + REQUESTS
        + """select job_id, task_index, round(cpu_request, 9) as cpu_request,
  round(memory_request, 9) as memory_request, round(cpu_usage, 9) as cpu_usage,
  round(memory_usage, 9) as memory_usage
from first_requests join samples using (job_id, task_index)""",
        "event_pairs": _pairs(0, 1, first_only=True)
        + "select job_id, round(elapsed / 1e6, 9) as elapsed_seconds from pairs",
        "pair_totals_hot": TRACE + FEW_JOBS.format(start=0, end=1) + PAIR_TOTALS,
        "event_pair_totals": _pairs(0, 1) + PAIR_TOTALS,
        "scalar_row": """select (select count(*) from orders) as orders,
  (select round(max(l_quantity), 9) from lineitem) as max_quantity""",
        "distribution": "select l_returnflag, l_linestatus, count(*) as count from lineitem group by all",
        "distribution_distinct": "select l_returnflag, count(distinct l_orderkey) as count from lineitem group by all",
        "count_if_by": """select l_suppkey, count(*) filter (l_returnflag = 'R') as matches, count(*) as total
from lineitem group by all""",
        "distinct_per_key": 'select l_orderkey, count(distinct l_suppkey) as "distinct" from lineitem group by all',
        "split_counts": """select count(*) filter (n = 1) as single, count(*) filter (n > 1) as several
from (select count(distinct l_suppkey) as n from lineitem group by l_orderkey)""",
        "usage_per_instant": TRACE
        + PEAKS
        + """select machine_id, start_time, round(cpu_usage, 9) as cpu_usage,
  round(memory_usage, 9) as memory_usage from instants""",
        "peak_usage": TRACE
        + PEAKS
        + """select machine_id, round(max_cpu_usage, 9) as max_cpu_usage,
  round(max_memory_usage, 9) as max_memory_usage from peaks""",
        "mean_by": "select o_orderpriority, round(avg(o_totalprice), 6) as mean from orders group by all",
        "summary": """select round(sum(l_quantity), 2) as sum, round(min(l_quantity), 9) as min,
  round(max(l_quantity), 9) as max, round(avg(l_quantity), 9) as mean from lineitem""",
        "pearson": "select round(corr(l_quantity, l_extendedprice), 9) as correlation from lineitem",
        "histogram": """with b as (
  select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 50 as width from lineitem),
c as (
  select least(floor((l_extendedprice - lo) / width), 49) as bin, count(*) as n
  from lineitem, b group by all)
select cast(g as integer) as bin, round(lo + g * width, 9) as bin_start,
  round(lo + (g + 1) * width, 9) as bin_end, coalesce(n, 0) as count
from range(50) t(g) cross join b left join c on g = bin""",
        "adjacent_pairs_hot": TRACE
        + """, neighbours as (
  select *, lead(event_type) over w as next_type, lead(time) over w as next_time
  from machine_events window w as (order by time, platform_id, event_id))
select 1 as "all", machine_id, round(cpus, 9) as cpus, time, next_time - time as elapsed
from neighbours where event_type = 1 and next_type = 0""",
        "adjacent_pairs": _neighbours("machine_id", "machine_events")
        + """select machine_id, time, round(cpus, 9) as cpus, next_time - time as elapsed
from neighbours where event_type = 1 and next_type = 0""",
        "above_mean": """select event_id, round(value, 9) as value from events
where value > 2 * (select avg(value) from events)""",
        "top_outliers": """select event_id, round(value, 9) as value from events
where value > 2 * (select avg(value) from events) order by value desc, event_id limit 10""",
        "sorted_by": "select c_nationkey, count(*) as count from customer group by all",
        "union_events": TRACE + UNION + f"select {SHOWN} from all_events",
        "replay_order": TRACE + UNION + f"select {SHOWN} from all_events",
        "replay_order_check": "select 2 * count(*) as rows, 0::bigint as out_of_order, 0::bigint as overlaps from events",
        "event_replay": TRACE + UNION + f"select {ROUTED}, {RECORD}, {JOB_FIELDS} from all_events",
        "hopping_usage": _windows("task_events") + HOPPING_USAGE,
        "tumbling_usage": _windows("task_events")
        + MACHINE_TOTALS
        + """select window_start, window_end, machine_id, round(total_cpu_usage, 9) as total_cpu_usage,
  round(total_memory_usage, 9) as total_memory_usage from totals""",
        "hopping_event_counts": _windows("job_events") + HOPPING_COUNTS,
        "event_counts_stream_no_watermark": _windows("job_events") + HOPPING_COUNTS,
        "resource_usage_stream": _windows("filled") + HOPPING_USAGE,
        "event_counts_stream": _windows("job_events") + HOPPING_COUNTS,
        "machine_metrics_stream": _windows("filled")
        + MACHINE_TOTALS
        + """, gauges as (
  select 'total_cpu_usage' as metric, machine_id, total_cpu_usage as value, window_end from totals
  union all
  select 'total_memory_usage', machine_id, total_memory_usage, window_end from totals)
select 'spark_job_metrics' as job, metric, cast(machine_id as varchar) as machine_id,
  round(value, 9) as value, window_end from gauges where value is not null
qualify row_number() over (partition by metric, machine_id order by window_end desc) = 1""",
        "machines_by_cpu": TRACE
        + """select round(cpus, 9) as cpu_capacity, count(*) as machine_count from machine_events
where event_type = 0 and cpus is not null group by all""",
        "machines_by_cpu_distinct": TRACE
        + """select round(cpus, 9) as cpu_capacity, count(distinct machine_id) as machine_count
from machine_events where event_type = 0 and cpus is not null group by all""",
        "jobs_by_class": _class_counts("job_events", "count(*)", "job_count"),
        "jobs_by_class_distinct": _class_counts("job_events", "count(distinct job_id)", "job_count"),
        "tasks_by_class": _class_counts("task_events", "count(*)", "task_count"),
        "tasks_by_class_distinct": _class_counts(
            "task_events", "count(distinct (job_id, task_index))", "task_count"
        ),
        "eviction_probability": EVICTION_SHARE + " having count(*) filter (event_type = 2) > 0",
        "eviction_probability_keep_zero": EVICTION_SHARE,
        "job_locality": TRACE
        + """, jobs as (
  select count(distinct machine_id) as n from task_events where machine_id is not null group by job_id)
select count(*) filter (n = 1) as single_machine_jobs, count(*) filter (n > 1) as multiple_machine_jobs,
  round(count(*) filter (n = 1) / count(*) * 100, 9) as percent_single_machine,
  round(count(*) filter (n > 1) / count(*) * 100, 9) as percent_multiple_machine from jobs""",
        "request_vs_usage": _request_correlation("requests"),
        "request_vs_usage_first_only": _request_correlation("first_requests"),
        "peaks_vs_evictions": TRACE
        + PEAKS
        + ", machines as (select * from peaks join evictions using (machine_id))"
        + CORRELATIONS,
        "peaks_vs_evictions_keep_zero": TRACE
        + PEAKS
        + """, machines as (
  select * replace (coalesce(eviction_count, 0) as eviction_count)
  from peaks left join evictions using (machine_id))"""
        + CORRELATIONS,
        "power_lost": _neighbours("machine_id", "machine_events")
        + """, lost as (
  select sum(coalesce(cpus, 0) * (next_time - time) / 1e6 / 3600) as lost
  from neighbours where event_type = 1 and next_type = 0),
capacity as (
  select avg(coalesce(cpus, 0)) as mean from machine_events where event_type = 0 group by machine_id),
total as (
  select (max(time) / 1e6 - min(time) / 1e6) / 3600 * (select sum(mean) from capacity) as total
  from machine_events)
select round(lost, 9) as lost_cpu_hours, round(total, 9) as total_cpu_hours,
  round(lost / total * 100, 9) as percent_lost from lost, total""",
        "scheduling_latency": _pairs(0, 1) + _mean("mean_latency_seconds"),
        "scheduling_latency_first_only": _pairs(0, 1, first_only=True) + _mean("mean_latency_seconds"),
        "slow_scheduled_jobs": _pairs(0, 1) + _outliers("latency_seconds"),
        "latency_by_hour": _latency_by_hour("hour"),
        "latency_by_hour_per_job": _latency_by_hour("hour, job_id"),
        "job_durations": _pairs(1, 4) + _mean("mean_duration_seconds"),
        "duration_histogram": _pairs(1, 4) + DURATIONS,
        "duration_histogram_hot": TRACE + FEW_JOBS.format(start=1, end=4) + DURATIONS,
        "long_jobs": _pairs(1, 4) + _outliers("duration_seconds"),
    }
