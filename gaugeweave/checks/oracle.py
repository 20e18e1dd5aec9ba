"""SQL text for the oracle: the same rules written once more for a single-node SQL engine.

Adjacent samples come from a self-join here and rounding from 128-bit integers, so the oracle shares
no method with the engine.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from gaugeweave.checks.fixtures import CAT, samples_sql
from gaugeweave.operators.report import inputs_of


def units(n: str, d: str, m: int) -> str:
    """n / d in 1/m steps, half away from zero."""
    big_n, big_d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    return (
        f"(sign({big_n}) * sign({big_d}) * ((2 * {m} * abs({big_n}) + abs({big_d})) // "
        f"(2 * nullif(abs({big_d}), 0))))"
    )


def rounded(n: str, d: str, digits: int, times: int = 1) -> str:
    return f"(CAST({units(n, d, times * 10**digits)} AS DOUBLE) / {10**digits})"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return rounded(part, whole, digits, 100)


def cents(x: str) -> str:
    return f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"


def mean(x: str, digits: int) -> str:
    whole = f"CAST(floor({x} * {10**digits} + 0.5) AS BIGINT)"
    return f"(CAST(sum({whole}) AS DOUBLE) / count({x}) / {float(10**digits)})"


def diff(metric: str) -> str:
    c, p = f'c."{metric}"', f'p."{metric}"'
    if CAT.is_gauge(metric):
        return f"{c} - {p}"
    return f"CASE WHEN {c} < {p} THEN {c} ELSE {c} - {p} END"


def delta_sql(metrics: Sequence[str], params: Sequence[str] = (), back: str = "1",
              extra: Sequence[str] = ()) -> str:
    """CTEs up to ``delta``."""
    cols = list(dict.fromkeys([*metrics, *params, *extra]))
    values = "".join(f', c."{m}" AS "{m}"' for m in [*metrics, *params])
    diffs = "".join(f', {diff(m)} AS "{m}_diff"' for m in metrics)
    return (
        f"{samples_sql(cols)}, delta AS (SELECT c.host AS host, c.id AS id, c.ts AS ts, "
        f"CAST(date_sub('second', p.ts, c.ts) AS BIGINT) AS ts_diff_seconds{values}{diffs} "
        f"FROM samples c JOIN samples p ON p.host = c.host AND p.id = c.id - {back})"
    )


def psec_columns(metrics: Iterable[str]) -> str:
    return "".join(f', {rounded(f"{m}_diff", "ts_diff_seconds", 2)} AS "{m}_psec"' for m in metrics)


def sample_sql(metrics: Sequence[str], params: Sequence[str] = (), rated: Sequence[str] | None = None) -> str:
    """CTEs up to ``sv``: deltas with rates."""
    rated = metrics if rated is None else rated
    return f"{delta_sql(metrics, params)}, sv AS (SELECT *{psec_columns(rated)} FROM delta)"


def bucket(grain: str) -> str:
    return "date_trunc('hour', ts)" if grain == "hour" else "CAST(ts AS DATE)"


def rollup_select(grain: str, metrics: Sequence[str], params: Sequence[str] = (), source: str = "delta",
                  rate_mode: str | None = None, where: str = "") -> str:
    b = bucket(grain)
    end = "b + INTERVAL 1 HOUR" if grain == "hour" else "CAST(b + INTERVAL 1 DAY AS DATE)"
    inner = "".join(f', max("{m}") AS "{m}"' for m in [*metrics, *params])
    inner += "".join(f', CAST(sum("{m}_diff") AS BIGINT) AS "{m}_diff"' for m in metrics)
    outer = ""
    if rate_mode == "mean":
        inner += "".join(
            f', CAST(sum({units(f"{m}_diff", "ts_diff_seconds", 100)}) AS BIGINT) AS "{m}_s"'
            f', count({units(f"{m}_diff", "ts_diff_seconds", 100)}) AS "{m}_n"' for m in metrics
        )
        outer = "".join(f', CAST({units(f"{m}_s", f"{m}_n", 1)} AS DOUBLE) / 100 AS "{m}_psec"' for m in metrics)
    elif rate_mode == "ratio":
        outer = psec_columns(metrics)
    named = "".join(f', "{c}"' for c in [*metrics, *[f"{m}_diff" for m in metrics], *params])
    return (
        f"SELECT host, id, b AS ts, {end} AS end_ts, ts_diff_seconds{named}{outer} FROM ("
        f"SELECT host, {b} AS b, min(id) AS id, CAST(sum(ts_diff_seconds) AS BIGINT) AS ts_diff_seconds{inner} "
        f"FROM {source} {where} GROUP BY host, {b})"
    )


def _formulas() -> dict[str, str]:
    f: dict[str, str] = {}
    total = "coalesce(queries_diff, questions_diff)"
    f["uptime_percent"] = (
        f"CASE WHEN {pct('uptime_diff', 'ts_diff_seconds')} > 100 THEN 100.0 "
        f"ELSE {pct('uptime_diff', 'ts_diff_seconds')} END"
    )
    f["innodb_buffer_pool_used_percent"] = pct(
        "(innodb_buffer_pool_pages_total - innodb_buffer_pool_pages_free)", "innodb_buffer_pool_pages_total")
    f["innodb_buffer_pool_pages_dirty_percent"] = pct("innodb_buffer_pool_pages_dirty", "innodb_buffer_pool_pages_total")
    f["innodb_read_hit_percent"] = pct(
        "(innodb_buffer_pool_read_requests_diff - innodb_buffer_pool_reads_diff)",
        "innodb_buffer_pool_read_requests_diff", 2)
    f["innodb_data_files_writes_psec"] = (
        f"CAST({cents('innodb_data_writes_psec')} - {cents('innodb_log_writes_psec')} - "
        f"{cents('innodb_dblwr_writes_psec')} AS DOUBLE) / 100"
    )
    f["innodb_estimated_log_mb_written_per_hour"] = rounded(
        f"({cents('innodb_os_log_written_psec')} * 3600)", "104857600", 1)
    f["mega_bytes_sent_psec"] = "bytes_sent_psec / CAST(1024 AS DOUBLE) / CAST(1024 AS DOUBLE)"
    f["mega_bytes_received_psec"] = "bytes_received_psec / CAST(1024 AS DOUBLE) / CAST(1024 AS DOUBLE)"
    for kind in ("read", "write"):
        asked, miss = f"key_{kind}_requests", f"key_{kind}s"
        f[f"key_{kind}_hits_psec"] = f"CAST({cents(asked + '_psec')} - {cents(miss + '_psec')} AS DOUBLE) / 100"
        f[f"key_{kind}_hit_percent"] = pct(f"({asked}_diff - {miss}_diff)", f"{asked}_diff")
    f["key_buffer_used_percent"] = pct("(key_buffer_size - key_blocks_unused * key_cache_block_size)", "key_buffer_size")
    for s in ("com_select", "com_insert", "com_insert_select", "com_update", "com_delete", "com_replace",
              "com_set_option", "com_commit", "slow_queries"):
        f[f"{s}_percent"] = pct(f"{s}_diff", total)
    for s in ("select_scan", "select_full_join", "select_range"):
        f[f"{s}_percent"] = pct(f"{s}_diff", "com_select_diff")
    f["table_lock_waited_percent"] = pct(
        "table_locks_waited_diff", "(table_locks_waited_diff + table_locks_immediate_diff)")
    cache = "coalesce(table_cache, 0) + coalesce(table_open_cache, 0)"
    f["table_cache_size"] = cache
    f["table_definition_cache_size"] = "coalesce(table_definition_cache, 0)"
    f["open_table_definitions"] = "coalesce(open_table_definitions, 0)"
    f["table_cache_use_percent"] = pct("open_tables", f"({cache})")
    f["opened_table_definitions_psec"] = "coalesce(opened_table_definitions_psec, 0)"
    f["created_disk_tmp_tables_percent"] = pct("created_tmp_disk_tables_diff", "created_tmp_tables_diff")
    f["max_connections_used_percent"] = pct("max_used_connections", "max_connections")
    f["aborted_connections_percent"] = pct("aborted_connects_diff", "connections_diff")
    f["thread_cache_used_percent"] = pct("threads_cached", "thread_cache_size")
    f["threads_connected_used_percent"] = pct("threads_connected", "max_connections")
    relay = "CASE max_relay_log_size WHEN 0 THEN max_binlog_size ELSE max_relay_log_size END"
    f["relay_log_space_limit_mb"] = "CAST(relay_log_space_limit AS DOUBLE) / 1048576"
    f["relay_log_max_size"] = relay
    f["relay_log_max_size_mb"] = f"CAST({relay} AS DOUBLE) / 1048576"
    f["relay_log_space_mb"] = "CAST(relay_log_space AS DOUBLE) / 1048576"
    f["relay_log_space_used_percent"] = pct("relay_log_space", "relay_log_space_limit")
    f["estimated_slave_catchup_seconds"] = (
        f"CASE WHEN seconds_behind_master_psec >= 0 THEN NULL ELSE "
        f"(100 * seconds_behind_master) // nullif(-{cents('seconds_behind_master_psec')}, 0) END"
    )
    f["os_loadavg"] = rounded("os_loadavg_millis", "1000", 2)
    busy = "os_cpu_user_diff + os_cpu_nice_diff + os_cpu_system_diff"
    f["os_cpu_utilization_percent"] = pct(f"({busy})", f"({busy} + os_cpu_idle_diff)")
    for area, parts in (("mem", ("total", "free", "active")), ("swap", ("total", "free"))):
        for p in parts:
            f[f"os_{area}_{p}_mb"] = rounded(f"os_{area}_{p}_kb", "1000", 1)
        f[f"os_{area}_used_mb"] = rounded(f"(os_{area}_total_kb - os_{area}_free_kb)", "1000", 1)
    return f


FORMULAS = _formulas()


def report_columns(names: Sequence[str]) -> str:
    """Report metrics; a name without a formula is a column passed through."""
    return "".join(f', {FORMULAS.get(n, chr(34) + n + chr(34))} AS "{n}"' for n in names)


def report_sql(names: Sequence[str], grain: str = "sample") -> str:
    """CTEs up to ``report``."""
    needs = inputs_of(names, CAT)
    if grain == "sample":
        base, source = sample_sql(needs.metrics, needs.params, needs.rates), "sv"
    else:
        base = (
            f"{delta_sql(needs.metrics, needs.params)}, "
            f"rolled AS ({rollup_select(grain, needs.metrics, needs.params)}), "
            f"svr AS (SELECT *{psec_columns(needs.rates)} FROM rolled)"
        )
        source = "svr"
    return f"{base}, report AS (SELECT host, id, ts, ts_diff_seconds{report_columns(names)} FROM {source})"
