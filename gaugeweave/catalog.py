"""What the engine knows about metrics, grains and charts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Configuration variables kept as parameters.
PARAMS = tuple(
    """
    auto_increment_increment binlog_cache_size bulk_insert_buffer_size concurrent_insert
    connect_timeout delay_key_write delayed_insert_limit delayed_insert_timeout delayed_queue_size
    expire_logs_days foreign_key_checks group_concat_max_len innodb_additional_mem_pool_size
    innodb_autoextend_increment innodb_autoinc_lock_mode innodb_buffer_pool_size innodb_checksums
    innodb_commit_concurrency innodb_concurrency_tickets innodb_fast_shutdown
    innodb_file_io_threads innodb_file_per_table innodb_flush_log_at_trx_commit
    innodb_force_recovery innodb_lock_wait_timeout innodb_log_buffer_size innodb_log_file_size
    innodb_log_files_in_group innodb_max_dirty_pages_pct innodb_max_purge_lag
    innodb_mirrored_log_groups innodb_open_files innodb_rollback_on_timeout
    innodb_stats_on_metadata innodb_support_xa innodb_sync_spin_loops innodb_table_locks
    innodb_thread_concurrency innodb_thread_sleep_delay join_buffer_size key_buffer_size
    key_cache_age_threshold key_cache_block_size key_cache_division_limit large_files_support
    large_page_size large_pages locked_in_memory log_queries_not_using_indexes log_slow_queries
    long_query_time low_priority_updates max_allowed_packet max_binlog_cache_size max_binlog_size
    max_connect_errors max_connections max_delayed_threads max_error_count max_heap_table_size
    max_insert_delayed_threads max_join_size max_length_for_sort_data max_prepared_stmt_count
    max_relay_log_size max_seeks_for_key max_sort_length max_sp_recursion_depth max_tmp_tables
    max_user_connections max_write_lock_count min_examined_row_limit multi_range_count
    myisam_data_pointer_size myisam_max_sort_file_size myisam_repair_threads
    myisam_sort_buffer_size myisam_use_mmap net_buffer_length net_read_timeout net_retry_count
    net_write_timeout old_passwords open_files_limit optimizer_prune_level optimizer_search_depth
    port preload_buffer_size profiling profiling_history_size protocol_version pseudo_thread_id
    query_alloc_block_size query_cache_limit query_cache_min_res_unit query_cache_size
    query_cache_type query_cache_wlock_invalidate query_prealloc_size range_alloc_block_size
    read_buffer_size read_only read_rnd_buffer_size relay_log_space_limit rpl_recovery_rank
    server_id skip_external_locking skip_networking skip_show_database slave_compressed_protocol
    slave_net_timeout slave_transaction_retries slow_launch_time slow_query_log sort_buffer_size
    sql_auto_is_null sql_big_selects sql_big_tables sql_buffer_result sql_log_bin sql_log_off
    sql_log_update sql_low_priority_updates sql_max_join_size sql_notes sql_quote_show_create
    sql_safe_updates sql_select_limit sql_warnings sync_binlog sync_frm table_cache
    table_definition_cache table_lock_wait_timeout table_open_cache thread_cache_size thread_stack
    timed_mutexes timestamp tmp_table_size transaction_alloc_block_size transaction_prealloc_size
    unique_checks updatable_views_with_limit wait_timeout warning_count
    """.split()
)

# Text variables that stay out of the sample table.
EXTRA = ("hostname", "datadir", "tmpdir", "version", "sql_mode")

# Status variables that may fall as well as rise, so their change is a plain difference.
GAUGES = tuple(
    """
    threads_cached threads_connected threads_running open_table_definitions open_tables
    slave_open_temp_tables qcache_free_blocks qcache_free_memory qcache_queries_in_cache
    qcache_total_blocks innodb_page_size innodb_buffer_pool_pages_total
    innodb_buffer_pool_pages_free innodb_buffer_pool_pages_data innodb_buffer_pool_pages_dirty
    innodb_buffer_pool_pages_flushed innodb_buffer_pool_pages_misc key_blocks_unused
    key_cache_block_size master_status_position read_master_log_pos relay_log_pos
    exec_master_log_pos relay_log_space seconds_behind_master
    """.split()
)

# Status columns every sample has, measured or not.
MANDATORY = tuple(
    """
    queries open_table_definitions opened_table_definitions innodb_buffer_pool_pages_total
    innodb_buffer_pool_pages_free innodb_buffer_pool_pages_data innodb_buffer_pool_pages_dirty
    innodb_buffer_pool_pages_flushed innodb_buffer_pool_pages_misc innodb_buffer_pool_reads
    innodb_buffer_pool_read_requests innodb_buffer_pool_read_ahead
    innodb_buffer_pool_read_ahead_evicted innodb_os_log_written innodb_row_lock_waits
    innodb_row_lock_current_waits innodb_row_lock_time innodb_rows_read innodb_rows_inserted
    innodb_rows_updated innodb_rows_deleted
    """.split()
)

# Replication fields of a sample.
REPLICATION = (
    "master_status_position",
    "master_status_file_number",
    "read_master_log_pos",
    "relay_log_pos",
    "exec_master_log_pos",
    "relay_log_space",
    "seconds_behind_master",
)

# Operating system fields of a sample.
OS_FIELDS = tuple(
    """
    os_loadavg_millis os_cpu_user os_cpu_nice os_cpu_system os_cpu_idle os_total_cpu_cores
    os_mem_total_kb os_mem_free_kb os_mem_active_kb os_swap_total_kb os_swap_free_kb
    os_root_mountpoint_usage_percent os_datadir_mountpoint_usage_percent
    os_tmpdir_mountpoint_usage_percent os_page_ins os_page_outs os_swap_ins os_swap_outs
    """.split()
)

# Parameters whose default may be 2**64 - 1: they keep twenty decimal digits.
WIDE_PARAMS = frozenset(
    """
    max_binlog_cache_size max_join_size max_seeks_for_key max_write_lock_count
    myisam_max_sort_file_size sql_max_join_size sql_select_limit
    """.split()
)

# Variables that are never stored.
SKIPPED_PREFIXES = ("ssl_", "ndb_")
SKIPPED_NAMES = ("last_query_cost", "rpl_status")

KEY_COLUMNS = ("host", "id", "ts")
CUSTOM_COLUMN = re.compile(r"^custom_(\d+)(_.+)?$")


@dataclass(frozen=True)
class MetricCatalog:
    """Classes of metrics; any column that is neither a key nor a parameter is a status metric."""

    params: tuple[str, ...] = PARAMS
    gauges: frozenset[str] = frozenset(GAUGES)
    mandatory: tuple[str, ...] = MANDATORY
    custom_ids: tuple[int, ...] = ()
    key_columns: tuple[str, ...] = KEY_COLUMNS
    _param_set: frozenset[str] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "_param_set", frozenset(self.params))

    def params_in(self, columns) -> list[str]:
        return [c for c in columns if c in self._param_set]

    def status_in(self, columns) -> list[str]:
        return [c for c in columns if c not in self._param_set and c not in self.key_columns]

    def is_gauge(self, name: str) -> bool:
        return name in self.gauges

    def type_of(self, name: str) -> str:
        return "decimal(20,0)" if name in WIDE_PARAMS else "long"

    def custom_columns(self) -> list[str]:
        return [f"custom_{i}" for i in self.custom_ids] + [f"custom_{i}_time" for i in self.custom_ids]

    def expected_columns(self) -> list[str]:
        """Every metric column a sample must carry, measured or not."""
        named = [*self.mandatory, *self.custom_columns(), *self.params, *REPLICATION, *OS_FIELDS]
        return list(dict.fromkeys(named))


@dataclass(frozen=True)
class Grain:
    """A time resolution of reports and its series, ticks and freshness settings."""

    name: str
    step_seconds: int
    recent: str
    tick: str
    tick_limit: int
    stale_after: str


# Step, recent window, tick unit, tick limit and staleness of each grain.
SAMPLE = Grain("sample", 600, "24 hours", "HOUR", 24, "1 hour")
HOUR = Grain("hour", 3600, "10 days", "DAY", 10, "2 hours")
DAY = Grain("day", 86400, "1 year", "WEEK", 52, "1 day")
GRAINS = {g.name: g for g in (SAMPLE, HOUR, DAY)}


@dataclass(frozen=True)
class Chart:
    """Series drawn together; ``from_zero`` and ``to_hundred`` widen the value axis."""

    alias: str
    series: tuple[str, ...]
    from_zero: bool = True
    to_hundred: bool = False


def _charts(text: str) -> tuple[Chart, ...]:
    charts = []
    for line in text.strip().splitlines():
        alias, flags, series = (part.strip() for part in line.split("|"))
        charts.append(Chart(alias, tuple(series.split()), "0" in flags.split(), "100" in flags.split()))
    return tuple(charts)


# Chart alias | axis contains 0 and/or 100 | series.
CHARTS = _charts(
    """
    uptime_percent | 0 100 | uptime_percent
    innodb_read_hit_percent | | innodb_read_hit_percent
    innodb_io | 0 | innodb_buffer_pool_reads_psec innodb_buffer_pool_pages_flushed_psec
    innodb_rw | 0 | innodb_data_files_writes_psec innodb_log_writes_psec innodb_dblwr_writes_psec innodb_data_reads_psec
    innodb_buffer_pool_usage | 0 100 | innodb_buffer_pool_used_percent innodb_buffer_pool_pages_dirty_percent
    innodb_buffer_pool_pages | 0 | innodb_buffer_pool_pages_total innodb_buffer_pool_pages_data innodb_buffer_pool_pages_dirty
    innodb_estimated_log_mb_written_per_hour | 0 | innodb_estimated_log_mb_written_per_hour
    innodb_row_lock_time_psec | 0 | innodb_row_lock_time_psec
    innodb_buffer_pool_read_ahead | 0 | innodb_buffer_pool_read_ahead_psec innodb_buffer_pool_read_ahead_evicted_psec
    network_io | 0 | mega_bytes_sent_psec mega_bytes_received_psec
    myisam_key_buffer_used_percent | 0 100 | key_buffer_used_percent
    myisam_key_hit | 0 | key_read_requests_psec key_reads_psec key_write_requests_psec key_writes_psec
    DML | 0 | com_select_psec com_insert_psec com_insert_select_psec com_delete_psec com_update_psec com_replace_psec
    questions | 0 | queries_psec questions_psec slow_queries_psec com_commit_psec com_set_option_psec
    innodb_rows | 0 | innodb_rows_inserted_psec innodb_rows_deleted_psec innodb_rows_updated_psec
    tmp_tables | 0 | created_tmp_tables_psec created_tmp_disk_tables_psec
    read_patterns | 0 | handler_read_rnd_psec handler_read_rnd_next_psec handler_read_first_psec handler_read_next_psec handler_read_prev_psec handler_read_key_psec
    table_locks_waited_psec | 0 | table_locks_waited_psec
    table_cache_use | 0 | table_cache_size open_tables table_definition_cache_size open_table_definitions
    opened_tables_psec | 0 | opened_tables_psec opened_table_definitions_psec
    connections | 0 | connections_psec aborted_connects_psec threads_created_psec
    connections_usage | 0 | max_connections threads_connected threads_running
    thread_cache_use | 0 | thread_cache_size threads_cached
    threads_created_psec | 0 | threads_created_psec
    relay_log_used_mb | 0 | relay_log_space_limit_mb relay_log_space_mb
    seconds_behind_master | 0 100 | seconds_behind_master
    seconds_behind_master_psec | 0 | seconds_behind_master_psec
    estimated_slave_catchup_seconds | 0 | estimated_slave_catchup_seconds
    os_cpu_utilization_percent | 0 100 | os_cpu_utilization_percent
    os_loadavg | 0 | os_loadavg os_total_cpu_cores
    os_memory | 0 | os_mem_total_mb os_mem_used_mb os_mem_active_mb os_swap_total_mb os_swap_used_mb
    os_page_io | 0 | os_page_ins_psec os_page_outs_psec
    os_swap_io | 0 | os_swap_ins_psec os_swap_outs_psec
    os_mountpoints_usage_percent | 0 100 | os_root_mountpoint_usage_percent os_datadir_mountpoint_usage_percent os_tmpdir_mountpoint_usage_percent
    """
)

# Series colours in drawing order.
SERIES_COLORS = ("ff8c00", "4682b4", "9acd32", "dc143c", "9932cc", "ffd700", "191970", "7fffd4", "808080", "dda0dd")

# Metrics of the weekday-by-hour profile.
PROFILE_METRICS = tuple(
    """
    innodb_read_hit_percent innodb_buffer_pool_reads_psec innodb_buffer_pool_pages_flushed_psec
    innodb_os_log_written_psec innodb_row_lock_time_psec mega_bytes_sent_psec
    mega_bytes_received_psec key_read_hit_percent key_write_hit_percent com_select_psec
    com_insert_psec com_delete_psec com_update_psec com_replace_psec com_set_option_percent
    com_commit_percent slow_queries_percent select_scan_psec select_full_join_psec
    select_range_psec table_locks_waited_psec opened_tables_psec created_tmp_tables_psec
    created_tmp_disk_tables_psec connections_psec aborted_connects_psec threads_created_psec
    seconds_behind_master os_loadavg os_cpu_utilization_percent os_mem_used_mb os_mem_active_mb
    os_swap_used_mb
    """.split()
)

# Sections of the brief report and the charts of the full report.
BRIEF_SECTIONS = (
    ("InnoDB & I/O", ("innodb_rw", "innodb_io", "network_io")),
    ("InnoDB", ("innodb_buffer_pool_pages", "innodb_buffer_pool_read_ahead", "innodb_estimated_log_mb_written_per_hour")),
    ("Questions", ("DML", "questions", "tmp_tables")),
    ("Resources", ("connections", "threads_created_psec", "opened_tables_psec")),
    ("Caches", ("myisam_key_hit", "thread_cache_use", "table_cache_use")),
    ("Vitals", ("seconds_behind_master", "connections_usage", "uptime_percent")),
    ("OS", ("os_memory", "os_cpu_utilization_percent", "os_loadavg")),
    ("", ("os_page_io", "os_swap_io", "os_mountpoints_usage_percent")),
)
FULL_REPORT = tuple(
    """
    innodb_read_hit_percent innodb_io innodb_rw innodb_row_lock_time_psec
    innodb_estimated_log_mb_written_per_hour innodb_buffer_pool_pages
    innodb_buffer_pool_read_ahead myisam_key_buffer_used_percent myisam_key_hit network_io DML
    questions innodb_rows tmp_tables read_patterns table_locks_waited_psec table_cache_use
    opened_tables_psec connections connections_usage thread_cache_use threads_created_psec
    relay_log_used_mb seconds_behind_master seconds_behind_master_psec uptime_percent
    os_cpu_utilization_percent os_loadavg os_memory os_page_io os_swap_io
    os_mountpoints_usage_percent
    """.split()
)

# Error levels, mildest first.
ERROR_LEVELS = ("debug", "info", "warning", "error", "critical")


def charts_with_custom(custom_ids=()) -> tuple[Chart, ...]:
    """The chart list plus value, time and rate charts of each custom query."""
    names = [f"custom_{i}{suffix}" for suffix in ("", "_time", "_psec") for i in custom_ids]
    return CHARTS + tuple(Chart(n, (n,)) for n in names)
