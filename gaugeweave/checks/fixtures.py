"""The given tables seen as samples of hosts.

The column expressions below are plain SQL that Spark and DuckDB both run. One host owns three of
every eight events. Event numbers are the sample numbers, so a host sees runs of a hundred adjacent
numbers with gaps between them, and two events of one second leave further gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.catalog import MetricCatalog
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.ingest import first_per_second
from gaugeweave.operators.report import METRICS, inputs_of

AS_OF = "2024-01-31 00:00:00"
CAT = MetricCatalog(custom_ids=(1, 2))

RUN = "CAST(floor(event_id / 100) AS BIGINT)"
HOST = f"CASE WHEN {RUN} % 8 < 3 THEN 'h0' ELSE concat('h', CAST({RUN} % 8 AS STRING)) END"


def _whole(expression: str) -> str:
    return f"CAST(floor({expression}) AS BIGINT)"


# Columns with a shape of their own: resets, gauges with NULL, slowly changing parameters.
SHAPED = {
    "uptime": "(event_id % 500) * 260",
    "queries": "CASE WHEN event_id % 50 = 7 THEN NULL ELSE event_id * 100 END",
    "com_replace": "(event_id % 900) * 7",
    "threads_connected": f"CASE WHEN event_type = 'error' THEN NULL ELSE {_whole('value')} END",
    "threads_running": _whole("value / 9"),
    "threads_cached": _whole("value / 40"),
    "open_tables": _whole("value / 3"),
    "open_table_definitions": f"CASE WHEN event_id % 4 = 1 THEN NULL ELSE {_whole('value / 5')} END",
    "opened_table_definitions": f"CASE WHEN event_id % 6 = 1 THEN NULL ELSE {_whole('event_id * 9 / 2')} END",
    "seconds_behind_master": f"CASE WHEN event_type = 'click' THEN {_whole('value')} ELSE 0 END",
    "os_cpu_user": "event_id * 3",
    "os_cpu_nice": "event_id",
    "os_cpu_system": "event_id * 2",
    "os_cpu_idle": "event_id * 5",
    "os_loadavg_millis": _whole("value * 10"),
    "os_total_cpu_cores": "8 + event_id % 2",
    "os_mem_total_kb": "16000000 + event_id % 7",
    "os_mem_free_kb": _whole("value * 20011"),
    "os_mem_active_kb": _whole("value * 7013"),
    "os_swap_total_kb": "2000000 + event_id % 3",
    "os_swap_free_kb": _whole("value * 3001"),
    "os_root_mountpoint_usage_percent": "event_id % 101",
    "os_datadir_mountpoint_usage_percent": "40 + event_id % 30",
    "os_tmpdir_mountpoint_usage_percent": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 55 END",
    "innodb_buffer_pool_pages_total": "8192 + event_id % 2",
    "innodb_buffer_pool_pages_free": _whole("value * 11"),
    "innodb_buffer_pool_pages_data": _whole("value * 5"),
    "innodb_buffer_pool_pages_dirty": _whole("value * 2"),
    "innodb_buffer_pool_pages_misc": _whole("value / 2"),
    "innodb_buffer_pool_pages_flushed": _whole("value * 31"),
    "innodb_row_lock_current_waits": _whole("value / 100"),
    "key_blocks_unused": _whole("value * 13"),
    "relay_log_space": _whole("value * 1000003"),
    "master_status_position": "event_id * 517",
    "master_status_file_number": "1 + event_id % 40",
    "max_used_connections": "100 + event_id % 333",
    "custom_1": _whole("value * 3"),
    "custom_1_time": "event_id % 17",
    "custom_2": f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE {_whole('value / 2')} END",
    "custom_2_time": "event_id % 29",
    "auto_increment_increment": "CASE WHEN event_id % 10 = 0 THEN 2 WHEN event_id % 10 = 5 THEN NULL ELSE 1 END",
    "max_connections": f"600 + 50 * {_whole('event_id / 2500')}",
    "table_cache": f"CASE WHEN event_id % 1000 < 10 THEN NULL ELSE 16 * (1 + {_whole('event_id / 700')}) END",
    "table_open_cache": "CASE WHEN event_id % 3 = 0 THEN 64 ELSE NULL END",
    "table_definition_cache": "CASE WHEN event_id % 5 = 2 THEN NULL ELSE 256 END",
    "thread_cache_size": f"8 * ({_whole('event_id / 450')} % 4)",
    "relay_log_space_limit": f"1073741824 * ({_whole('event_id / 60')} % 3)",
    "max_relay_log_size": f"104857601 * ({_whole('event_id / 80')} % 2)",
    "max_binlog_size": "CASE WHEN event_id % 1000 = 0 THEN NULL ELSE 1073741824 END",
    "innodb_buffer_pool_size": f"134217728 * (1 + {_whole('event_id / 4000')})",
    "innodb_flush_log_at_trx_commit": f"{_whole('event_id / 330')} % 3",
    "key_buffer_size": f"8388608 * ({_whole('event_id / 900')} % 3)",
    "key_cache_block_size": "1024",
    "long_query_time": "10",
    "tmp_table_size": "33554432",
    "max_heap_table_size": "16777216",
    "sync_binlog": f"{_whole('event_id / 97')} % 2",
    "timestamp": "1700000000 + event_id",
}


def _counter(i: int) -> str:
    return _whole(f"event_id * {37 * (i % 11 + 1)} / {2 + (i * 5) % 13}")


_needed = inputs_of(METRICS, CAT)
STATUS = tuple(sorted({*_needed.metrics, "custom_1", "custom_1_time", "custom_2", "custom_2_time"}))
PARAM_COLUMNS = tuple(sorted({*_needed.params, "auto_increment_increment", "sync_binlog", "timestamp"}))

COLUMNS = {
    name: SHAPED.get(name) or _counter(i) for i, name in enumerate([*STATUS, *PARAM_COLUMNS])
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast(NTZ)


def raw_samples(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Every event as a sample, seconds not yet unique."""
    events = table(spark, sf_dir, "events")
    picked = [f"CAST({COLUMNS[c]} AS BIGINT) AS `{c}`" for c in columns]
    return events.selectExpr(f"{HOST} AS host", "event_id AS id", "ts", *picked)


def ev_samples(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Samples as stored: one per host and second."""
    return first_per_second(raw_samples(spark, sf_dir, columns))


def raw_samples_sql(columns: Sequence[str]) -> str:
    picked = "".join(f', CAST({COLUMNS[c]} AS BIGINT) AS "{c}"' for c in columns)
    return f"SELECT {HOST} AS host, event_id AS id, ts{picked} FROM events"


def samples_sql(columns: Sequence[str]) -> str:
    """The CTE bodies ``ev`` and ``samples`` for the oracle."""
    picked = "".join(f', "{c}"' for c in columns)
    return (
        f"ev AS ({raw_samples_sql(columns)}), "
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY host, date_trunc('second', ts) ORDER BY id) AS rn FROM ev), "
        f"samples AS (SELECT host, id, date_trunc('second', ts) AS ts{picked} FROM numbered WHERE rn = 1)"
    )
