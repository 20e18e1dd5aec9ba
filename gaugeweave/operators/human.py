"""One readable text per report row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.catalog import MetricCatalog
from gaugeweave.functions.numeric import div, ratio_units, round_ratio
from gaugeweave.functions.text import fixed
from gaugeweave.functions.timefn import NTZ, clock, plus_seconds, stamp
from gaugeweave.operators.report import registry

# The text of a report. {name} is a metric, {name?} reads N/A when it is NULL,
# {name:mb} is a byte count in MB with one digit, {=name} is worked out below.
TEMPLATE = """Report period: {=from} to {=to}. Period is {=minutes} minutes ({=hours} hours)
Uptime: {uptime_percent}% (Up: {=up_days} days, {=up_clock} hours)

OS:
    Load average: {os_loadavg?}
    CPU utilization: {os_cpu_utilization_percent?}%
    Memory: {os_mem_used_mb?}MB used out of {os_mem_total_mb?}MB (Active: {os_mem_active_mb?}MB)
    Swap: {os_swap_used_mb?}MB used out of {os_swap_total_mb?}MB
    Mountpoints usage: root {os_root_mountpoint_usage_percent}%, datadir {os_datadir_mountpoint_usage_percent}%, tmpdir {os_tmpdir_mountpoint_usage_percent}%

InnoDB:
    innodb_buffer_pool_size: {innodb_buffer_pool_size} bytes ({innodb_buffer_pool_size:mb}MB). Used: {innodb_buffer_pool_used_percent?}%
    Read hit: {innodb_read_hit_percent?}%
    Disk I/O: {innodb_buffer_pool_reads_psec} reads/sec  {innodb_buffer_pool_pages_flushed_psec} flushes/sec
    Estimated log written per hour: {innodb_estimated_log_mb_written_per_hour?}MB
    Locks: {innodb_row_lock_waits_psec}/sec  current: {innodb_row_lock_current_waits}

MyISAM key cache:
    key_buffer_size: {key_buffer_size} bytes ({key_buffer_size:mb}MB). Used: {key_buffer_used_percent?}%
    Read hit: {key_read_hit_percent?}%  Write hit: {key_write_hit_percent?}%

DML:
    SELECT:  {com_select_psec}/sec  {com_select_percent?}%
    INSERT:  {com_insert_psec}/sec  {com_insert_percent?}%
    UPDATE:  {com_update_psec}/sec  {com_update_percent?}%
    DELETE:  {com_delete_psec}/sec  {com_delete_percent?}%
    REPLACE: {com_replace_psec}/sec  {com_replace_percent?}%
    SET:     {com_set_option_psec}/sec  {com_set_option_percent?}%
    COMMIT:  {com_commit_psec}/sec  {com_commit_percent?}%
    slow:    {slow_queries_psec}/sec  {slow_queries_percent?}% (slow time: {long_query_time}sec)

Selects:
    Full scan: {select_scan_psec}/sec  {select_scan_percent?}%
    Full join: {select_full_join_psec}/sec  {select_full_join_percent?}%
    Range:     {select_range_psec}/sec  {select_range_percent?}%
    Sort merge passes: {sort_merge_passes_psec}/sec

Locks:
    Table locks waited:  {table_locks_waited_psec}/sec  {table_lock_waited_percent?}%

Tables:
    Table cache: {table_cache_size}. Used: {table_cache_use_percent?}%
    Opened tables: {opened_tables_psec}/sec

Temp tables:
    Max tmp table size:  {tmp_table_size} bytes ({tmp_table_size:mb}MB)
    Max heap table size: {max_heap_table_size} bytes ({max_heap_table_size:mb}MB)
    Created:             {created_tmp_tables_psec}/sec
    Created disk tables: {created_tmp_disk_tables_psec}/sec  {created_disk_tmp_tables_percent?}%

Connections:
    Max connections: {max_connections}. Max used: {max_used_connections}  {max_connections_used_percent?}%
    Connections: {connections_psec}/sec
    Aborted:     {aborted_connects_psec}/sec  {aborted_connections_percent?}%

Threads:
    Thread cache: {thread_cache_size}. Used: {thread_cache_used_percent?}%
    Created: {threads_created_psec}/sec

Replication:
    Master status file number: {master_status_file_number?}, position: {master_status_position?}
    Relay log space limit: {relay_log_space_limit?}, used: {relay_log_space?}  ({relay_log_space_used_percent?}%)
    Seconds behind master: {seconds_behind_master?}
    Estimated time for slave to catch up: {estimated_slave_catchup_seconds?} seconds ({=eta_days} days, {=eta_clock} hours)  ETA: {=eta}
"""

FIELD = re.compile(r"\{(=?)(\w+)(\?|:mb)?\}")
DAY_SECONDS = 86400


def metrics_needed() -> list[str]:
    """Report metrics the text mentions."""
    named = [name for derived, name, _ in FIELD.findall(TEMPLATE) if not derived]
    return list(dict.fromkeys([*named, "uptime"]))


def _derived() -> dict[str, Column]:
    secs, up = F.col("ts_diff_seconds"), F.col("uptime")
    start = F.col("ts").cast(NTZ)
    minutes = ratio_units(secs, F.lit(60), 1)
    eta = F.col("estimated_slave_catchup_seconds")
    unknown = F.lit("N/A")
    return {
        "from": stamp(start),
        "to": stamp(plus_seconds(start, minutes * 60)),
        "minutes": minutes.cast("string"),
        "hours": fixed(round_ratio(secs, F.lit(3600), 2), 2),
        "up_days": div(up, F.lit(DAY_SECONDS)).cast("string"),
        "up_clock": F.when(up.isNotNull(), clock(up % DAY_SECONDS)),
        "eta_days": F.coalesce(div(eta, F.lit(DAY_SECONDS)).cast("string"), unknown),
        "eta_clock": F.coalesce(F.when(eta.isNotNull(), clock(eta % DAY_SECONDS)), unknown),
        "eta": F.coalesce(stamp(plus_seconds(start, eta)), unknown),
    }


def text_parts(template: str, cat: MetricCatalog) -> Sequence[Column]:
    """Literal and field columns of a template, in order."""
    known, derived = registry(cat.custom_ids), _derived()
    parts: list[Column] = []
    at = 0
    for m in FIELD.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        is_derived, name, mode = m.groups()
        if is_derived:
            parts.append(derived[name])
        elif mode == ":mb":
            parts.append(fixed(round_ratio(F.col(name), F.lit(1024 * 1024), 1), 1))
        else:
            shown = fixed(F.col(name), known[name].digits)
            parts.append(F.coalesce(shown, F.lit("N/A")) if mode else shown)
        at = m.end()
    return [*parts, F.lit(template[at:])]


def human(report: DataFrame, cat: MetricCatalog = MetricCatalog()) -> DataFrame:
    """(host, id, ts, report). As in any concatenation, a NULL without a default makes the text NULL."""
    return report.select("host", "id", "ts", F.concat(*text_parts(TEMPLATE, cat)).alias("report"))
