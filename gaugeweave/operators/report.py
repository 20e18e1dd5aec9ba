"""The report: named metrics declared as expressions over values, changes, rates and parameters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gaugeweave.catalog import MetricCatalog
from gaugeweave.functions.numeric import percent_text, round_text, units_text

SECONDS = "ts_diff_seconds"


@dataclass(frozen=True)
class Metric:
    """A report column: its decimals, the columns it reads, and its SQL expression."""

    name: str
    digits: int
    inputs: tuple[str, ...]
    expr: str


def _value(*names: str) -> list[Metric]:
    return [Metric(n, 0, (n,), n) for n in names]


def _diff(*names: str) -> list[Metric]:
    return [Metric(f"{n}_diff", 0, (f"{n}_diff",), f"{n}_diff") for n in names]


def _rate(*names: str) -> list[Metric]:
    return [Metric(f"{n}_psec", 2, (f"{n}_psec",), f"{n}_psec") for n in names]


def _share(name: str, part: str, whole: str) -> Metric:
    return Metric(name, 1, (part, whole), percent_text(part, whole))


def _share_of_queries(part: str) -> Metric:
    inputs = (f"{part}_diff", "queries_diff", "questions_diff")
    return Metric(f"{part}_percent", 1, inputs, percent_text(inputs[0], "coalesce(queries_diff, questions_diff)"))


def _hit(name: str, miss: str, asked: str, digits: int = 1) -> Metric:
    """100 minus the percent of misses, rounded once."""
    return Metric(name, digits, (miss, asked), percent_text(f"{asked} - {miss}", asked, digits))


def _minus(name: str, first: str, *others: str) -> Metric:
    """Difference of rates, taken in hundredths."""
    inputs = (first, *others)
    return Metric(name, 2, inputs, f"({' - '.join(units_text(c, 2) for c in inputs)}) / 100")


def _megabytes(name: str, source: str) -> Metric:
    return Metric(name, 6, (source,), f"{source} / 1048576D")


def _scaled(name: str, source: str, divisor: int, digits: int) -> Metric:
    return Metric(name, digits, (source,), round_text(source, f"{divisor}L", digits))


def _used(name: str, total: str, free: str) -> Metric:
    """Used memory in thousands of kilobytes."""
    return Metric(name, 1, (total, free), round_text(f"{total} - {free}", "1000L", 1))


def _or_zero(name: str, *sources: str, digits: int = 0) -> Metric:
    return Metric(name, digits, sources, " + ".join(f"coalesce({s}, 0)" for s in sources))


TABLE_CACHE = ("table_cache", "table_open_cache")
CPU = ("os_cpu_user_diff", "os_cpu_nice_diff", "os_cpu_system_diff", "os_cpu_idle_diff")
_uptime = percent_text("uptime_diff", SECONDS)
# least() skips NULL, so the cap applies only to a known value.
UPTIME_PERCENT = f"CASE WHEN {_uptime} > 100 THEN 100D ELSE {_uptime} END"
LOG_MB_PER_HOUR = round_text(f"{units_text('innodb_os_log_written_psec', 2)} * 3600", f"{100 * 1024 * 1024}L", 1)
KEY_BUFFER_USED = percent_text("key_buffer_size - key_blocks_unused * key_cache_block_size", "key_buffer_size")
TABLE_CACHE_USE = percent_text("open_tables", " + ".join(f"coalesce({c}, 0)" for c in TABLE_CACHE))
LOCKS_WAITED = percent_text("table_locks_waited_diff", "table_locks_waited_diff + table_locks_immediate_diff")
RELAY_MAX = "CASE WHEN max_relay_log_size = 0 THEN max_binlog_size ELSE max_relay_log_size END"
_pace = units_text("seconds_behind_master_psec", 2)
# Seconds until the lag is gone at the current rate; NULL while it grows or stands still.
CATCH_UP = f"CASE WHEN {_pace} < 0 THEN (seconds_behind_master * 100) div (-{_pace}) END"
CPU_USE = percent_text(" + ".join(CPU[:3]), " + ".join(CPU))
_RELAY_INPUTS = ("max_relay_log_size", "max_binlog_size")


def _build() -> list[Metric]:
    m: list[Metric] = []
    m += _value("uptime")
    m += [Metric("uptime_percent", 1, ("uptime_diff",), UPTIME_PERCENT)]
    m += _value("innodb_buffer_pool_size", "innodb_flush_log_at_trx_commit", "innodb_buffer_pool_pages_total",
                "innodb_buffer_pool_pages_data", "innodb_buffer_pool_pages_dirty", "innodb_buffer_pool_pages_misc")
    m += [_hit("innodb_buffer_pool_used_percent", "innodb_buffer_pool_pages_free", "innodb_buffer_pool_pages_total"),
          _share("innodb_buffer_pool_pages_dirty_percent", "innodb_buffer_pool_pages_dirty",
                 "innodb_buffer_pool_pages_total"),
          _hit("innodb_read_hit_percent", "innodb_buffer_pool_reads_diff", "innodb_buffer_pool_read_requests_diff", 2)]
    m += _rate("innodb_buffer_pool_reads", "innodb_buffer_pool_pages_flushed", "innodb_dblwr_writes",
               "innodb_log_writes")
    m += [_minus("innodb_data_files_writes_psec", "innodb_data_writes_psec", "innodb_log_writes_psec",
                 "innodb_dblwr_writes_psec")]
    m += _rate("innodb_data_reads", "innodb_os_log_written")
    m += [Metric("innodb_estimated_log_mb_written_per_hour", 1, ("innodb_os_log_written_psec",), LOG_MB_PER_HOUR)]
    m += _rate("innodb_row_lock_waits")
    m += _value("innodb_row_lock_current_waits")
    m += _rate("innodb_row_lock_time", "innodb_buffer_pool_read_ahead", "innodb_buffer_pool_read_ahead_evicted")
    m += [_megabytes("mega_bytes_sent_psec", "bytes_sent_psec"),
          _megabytes("mega_bytes_received_psec", "bytes_received_psec")]
    m += _value("key_buffer_size")
    m += _diff("key_reads", "key_read_requests", "key_writes", "key_write_requests")
    m += _rate("key_reads", "key_read_requests", "key_writes", "key_write_requests")
    m += [_minus("key_read_hits_psec", "key_read_requests_psec", "key_reads_psec"),
          _minus("key_write_hits_psec", "key_write_requests_psec", "key_writes_psec"),
          Metric("key_buffer_used_percent", 1, ("key_blocks_unused", "key_cache_block_size", "key_buffer_size"),
                 KEY_BUFFER_USED),
          _hit("key_read_hit_percent", "key_reads_diff", "key_read_requests_diff"),
          _hit("key_write_hit_percent", "key_writes_diff", "key_write_requests_diff")]
    statements = ("com_select", "com_insert", "com_insert_select", "com_update", "com_delete", "com_replace",
                  "com_set_option", "com_commit", "slow_queries")
    m += _rate(*statements, "questions", "queries")
    m += [_share_of_queries(s) for s in statements]
    m += _value("long_query_time")
    m += _rate("innodb_rows_read", "innodb_rows_inserted", "innodb_rows_updated", "innodb_rows_deleted",
               "handler_read_rnd", "handler_read_rnd_next", "handler_read_first", "handler_read_next",
               "handler_read_prev", "handler_read_key", "select_scan", "select_full_join", "select_range")
    m += [_share(f"{s}_percent", f"{s}_diff", "com_select_diff")
          for s in ("select_scan", "select_full_join", "select_range")]
    m += _rate("sort_merge_passes", "table_locks_waited")
    m += [Metric("table_lock_waited_percent", 1, ("table_locks_waited_diff", "table_locks_immediate_diff"),
                 LOCKS_WAITED)]
    m += [_or_zero("table_cache_size", *TABLE_CACHE),
          _or_zero("table_definition_cache_size", "table_definition_cache")]
    m += _value("open_tables")
    m += [_or_zero("open_table_definitions", "open_table_definitions"),
          Metric("table_cache_use_percent", 1, ("open_tables", *TABLE_CACHE), TABLE_CACHE_USE)]
    m += _rate("opened_tables")
    m += [_or_zero("opened_table_definitions_psec", "opened_table_definitions_psec", digits=2)]
    m += _value("tmp_table_size", "max_heap_table_size")
    m += _rate("created_tmp_tables", "created_tmp_disk_tables")
    m += [_share("created_disk_tmp_tables_percent", "created_tmp_disk_tables_diff", "created_tmp_tables_diff")]
    m += _value("max_connections", "max_used_connections")
    m += [_share("max_connections_used_percent", "max_used_connections", "max_connections")]
    m += _rate("connections", "aborted_connects")
    m += [_share("aborted_connections_percent", "aborted_connects_diff", "connections_diff")]
    m += _value("thread_cache_size", "threads_cached")
    m += [_share("thread_cache_used_percent", "threads_cached", "thread_cache_size")]
    m += _rate("threads_created")
    m += _value("threads_connected")
    m += [_share("threads_connected_used_percent", "threads_connected", "max_connections")]
    m += _value("threads_running", "master_status_file_number", "master_status_position", "relay_log_space_limit")
    m += [_megabytes("relay_log_space_limit_mb", "relay_log_space_limit")]
    m += _value("max_relay_log_size")
    m += [Metric("relay_log_max_size", 0, _RELAY_INPUTS, RELAY_MAX),
          Metric("relay_log_max_size_mb", 6, _RELAY_INPUTS, f"{RELAY_MAX} / 1048576D")]
    m += _value("relay_log_space")
    m += [_megabytes("relay_log_space_mb", "relay_log_space"),
          _share("relay_log_space_used_percent", "relay_log_space", "relay_log_space_limit")]
    m += _value("seconds_behind_master")
    m += _rate("seconds_behind_master")
    m += [Metric("estimated_slave_catchup_seconds", 0, ("seconds_behind_master", "seconds_behind_master_psec"),
                 CATCH_UP),
          _scaled("os_loadavg", "os_loadavg_millis", 1000, 2)]
    m += _value("os_total_cpu_cores")
    m += [Metric("os_cpu_utilization_percent", 1, CPU, CPU_USE),
          _scaled("os_mem_total_mb", "os_mem_total_kb", 1000, 1),
          _scaled("os_mem_free_mb", "os_mem_free_kb", 1000, 1),
          _scaled("os_mem_active_mb", "os_mem_active_kb", 1000, 1),
          _used("os_mem_used_mb", "os_mem_total_kb", "os_mem_free_kb"),
          _scaled("os_swap_total_mb", "os_swap_total_kb", 1000, 1),
          _scaled("os_swap_free_mb", "os_swap_free_kb", 1000, 1),
          _used("os_swap_used_mb", "os_swap_total_kb", "os_swap_free_kb")]
    m += _value("os_root_mountpoint_usage_percent", "os_datadir_mountpoint_usage_percent",
                "os_tmpdir_mountpoint_usage_percent")
    m += _rate("os_page_ins", "os_page_outs", "os_swap_ins", "os_swap_outs")
    return m


METRICS: dict[str, Metric] = {m.name: m for m in _build()}


def registry(custom_ids: Iterable[int] = ()) -> dict[str, Metric]:
    """All report metrics, with value, time and rate of each custom query."""
    ids = list(custom_ids)
    extra = _value(*[f"custom_{i}" for i in ids]) + _rate(*[f"custom_{i}" for i in ids])
    extra += _value(*[f"custom_{i}_time" for i in ids])
    return METRICS | {m.name: m for m in extra}


def digits_of(names: Iterable[str], custom_ids: Iterable[int] = ()) -> dict[str, int]:
    known = registry(custom_ids)
    return {n: known[n].digits for n in names}


@dataclass(frozen=True)
class Inputs:
    """What a set of report metrics reads, so that deltas compute nothing else."""

    metrics: tuple[str, ...]
    rates: tuple[str, ...]
    params: tuple[str, ...]


def inputs_of(names: Iterable[str], cat: MetricCatalog) -> Inputs:
    known = registry(cat.custom_ids)
    metrics: dict[str, None] = {}
    rated: dict[str, None] = {}
    params: dict[str, None] = {}
    for column in (c for n in names for c in known[n].inputs):
        base = column.removesuffix("_psec").removesuffix("_diff")
        if base in cat.params:
            params[base] = None
            continue
        metrics[base] = None
        if column.endswith("_psec"):
            rated[base] = None
    return Inputs(tuple(metrics), tuple(rated), tuple(params))


def report(rows: DataFrame, names: Sequence[str], cat: MetricCatalog) -> DataFrame:
    """Report metrics of samples or rollups that carry the needed values, changes and rates."""
    known = registry(cat.custom_ids)
    return rows.selectExpr("host", "id", "ts", SECONDS, *[f"{known[n].expr} AS `{n}`" for n in names])
