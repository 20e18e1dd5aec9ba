"""Sources: scans, snapshots, operating system facts, schema alignment."""

from pyspark.sql import functions as F

from gaugeweave.catalog import MetricCatalog
from gaugeweave.checks.fixtures import CAT, HOST, ev_samples, raw_samples, table
from gaugeweave.checks.oracle import samples_sql
from gaugeweave.checks.registry import Family
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.ingest import align_rollup, align_schema, append_samples, first_per_second
from gaugeweave.sources.hosts import mount_samples, os_samples
from gaugeweave.sources.snapshots import (
    binlog_number,
    normalize_value,
    replication_fields,
    snapshot_to_samples,
    wanted,
    with_replication,
)
from gaugeweave.sources.tables import append_rows, read_hosts, read_table, scan_samples, union_hosts
from gaugeweave.session import scratch_dir

FAMILY = Family()


@FAMILY.add(
    "a1_sample_scan",
    f"WITH {samples_sql(['com_select', 'threads_connected'])} SELECT * FROM samples "
    "WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'",
)
def a1(spark, sf):
    stored = ev_samples(spark, sf, ["com_select", "threads_connected", "bytes_sent"])
    moment = lambda t: F.lit(t).cast(NTZ)
    return scan_samples(stored, ["com_select", "threads_connected"], moment("2024-01-05"), moment("2024-01-20"))


@FAMILY.add(
    "a1_table_round_trip",
    f"WITH {samples_sql(['com_select', 'threads_connected'])} SELECT * FROM samples",
)
def a1_table(spark, sf):
    path = scratch_dir(spark, "samples")
    append_rows(ev_samples(spark, sf, ["com_select", "threads_connected"]), path, shards=2)
    return read_table(spark, path)


# One name/value row per event and variable: (kind, name, text). Host h3 does not replicate.
RAW = (
    ("status", "' Com_Select '", "CAST(event_id * 3 AS STRING)"),
    ("status", "'Threads_Connected'", "CASE WHEN event_type = 'error' THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END"),
    ("status", "'Slave_running'", "CASE WHEN event_id % 2 = 0 THEN 'ON' ELSE 'Off' END"),
    ("status", "'Ssl_accepts'", "'5'"),
    ("status", "'NDB_cluster'", "'1'"),
    ("status", "'Last_query_cost'", "'0.5'"),
    ("status", "'Rpl_status'", "'AUTH_MASTER'"),
    ("status", "'Uptime'", "CAST(event_id % 500 AS STRING)"),
    ("variables", "'concurrent_insert'", "CASE event_id % 4 WHEN 0 THEN 'NEVER' WHEN 1 THEN 'AUTO' WHEN 2 THEN 'Always' ELSE '2' END"),
    ("variables", "'delay_key_write'", "CASE event_id % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'ON' ELSE 'OFF' END"),
    ("variables", "'query_cache_type'", "CASE event_id % 2 WHEN 0 THEN 'DEMAND' ELSE 'ON' END"),
    ("variables", "'Max_Connections'", "CAST(600 + event_id % 9 AS STRING)"),
    ("variables", "'max_join_size'", "'18446744073709551615'"),
    ("variables", "'slow_query_log'", "CASE event_id % 3 WHEN 0 THEN 'Not Started' WHEN 1 THEN 'started' ELSE 'yes' END"),
    ("variables", "'read_only'", "CASE event_id % 3 WHEN 0 THEN 'NO' ELSE 'unknown text' END"),
    ("variables", "'Long_Query_Time'", "CASE event_id % 4 WHEN 0 THEN '10.000000' WHEN 1 THEN '0.5' WHEN 2 THEN '-1' ELSE '-2.5' END"),
    ("variables", "'Version'", "'5.1.50-log'"),
    ("master", "'File'", "concat('mysql-bin.', CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '000' END, CAST(event_id % 90 AS STRING))"),
    ("master", "'Position'", "CAST(event_id * 17 AS STRING)"),
    ("slave", "'Seconds_Behind_Master'", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 60 AS STRING) END"),
    ("slave", "'Relay_Log_Space'", "CAST(event_id * 1000 AS STRING)"),
    ("slave", "'Read_Master_Log_Pos'", "CAST(event_id * 7 AS STRING)"),
    ("slave", "'Relay_Log_Pos'", "CAST(event_id * 5 AS STRING)"),
    ("slave", "'Exec_Master_Log_Pos'", "CAST(event_id * 3 AS STRING)"),
    ("slave", "'Slave_IO_State'", "'Waiting'"),
)
RAW_SQL = "raw AS (" + " UNION ALL ".join(
    f"SELECT {HOST} AS host, event_id AS snapshot_id, ts, '{k}' AS kind, {n} AS name, {v} AS value FROM events "
    f"WHERE NOT ('{k}' IN ('master', 'slave') AND {HOST} = 'h3')"
    for k, n, v in RAW
) + ")"


def raw_rows(spark, sf):
    entries = ", ".join(f"struct('{k}' AS kind, {n} AS name, {v} AS value)" for k, n, v in RAW)
    rows = table(spark, sf, "events").selectExpr(
        f"{HOST} AS host", "event_id AS snapshot_id", "ts", f"inline(array({entries}))")
    return rows.where("NOT (kind IN ('master', 'slave') AND host = 'h3')")


NUMBER = (
    "CASE WHEN n = 'concurrent_insert' AND v = 'never' THEN 0 WHEN n = 'concurrent_insert' AND v = 'auto' THEN 1 "
    "WHEN n = 'concurrent_insert' AND v = 'always' THEN 2 WHEN n = 'delay_key_write' AND v = 'all' THEN 2 "
    "WHEN v IN ('off', 'no', 'not started') THEN 0 WHEN v IN ('on', 'yes', 'started') THEN 1 WHEN v = 'demand' THEN 2 "
    "ELSE CAST(round(TRY_CAST(v AS DECIMAL(38,6))) AS HUGEINT) END"
)
CLEAN_SQL = (
    f"{RAW_SQL}, clean AS (SELECT host, snapshot_id, ts, kind, lower(trim(name)) AS n, lower(value) AS v FROM raw), "
    "kept AS (SELECT * FROM clean WHERE (kind = 'status' AND NOT (n LIKE 'ssl!_%' ESCAPE '!' OR n LIKE 'ndb!_%' ESCAPE '!' "
    "OR n IN ('last_query_cost', 'rpl_status'))) OR (kind = 'variables' AND n IN ('concurrent_insert', 'delay_key_write', "
    "'query_cache_type', 'max_connections', 'max_join_size', 'slow_query_log', 'read_only', 'long_query_time'))), "
    f"numbers AS (SELECT *, {NUMBER} AS number FROM kept)"
)
PIVOTED = ["com_select", "threads_connected", "slave_running", "uptime", "concurrent_insert", "delay_key_write",
           "query_cache_type", "max_connections", "slow_query_log", "read_only", "long_query_time"]
PIVOT_COLUMNS = ", ".join(f"CAST(max(CASE WHEN n = '{c}' THEN number END) AS BIGINT) AS {c}" for c in PIVOTED)


@FAMILY.add(
    "a2_snapshot_pivot",
    f"WITH {CLEAN_SQL} SELECT host, snapshot_id AS id, ts, {PIVOT_COLUMNS} FROM numbers GROUP BY host, snapshot_id, ts",
)
def a2(spark, sf):
    return snapshot_to_samples(raw_rows(spark, sf), CAT, PIVOTED, expected=[])


SEEN = ["click", "error", "purchase", "signup", "view"]
STRANGE = (
    ("status", "concat(' Seen_', event_type)", "CAST(event_id AS STRING)"),
    ("status", "'Very_Large'", "CASE WHEN event_id % 3 = 0 THEN '18446744073709551615' ELSE CAST(event_id AS STRING) END"),
    ("status", "'Open_Tables'", "CAST(-event_id AS STRING)"),
)
STRANGE_SQL = " UNION ALL ".join(
    f"SELECT {HOST} AS host, event_id AS snapshot_id, ts, '{k}' AS kind, {n} AS name, {v} AS value FROM events" for k, n, v in STRANGE)


@FAMILY.add(
    "a2_observed_columns",
    f"WITH {CLEAN_SQL.replace('UNION ALL', 'UNION ALL ' + STRANGE_SQL + ' UNION ALL', 1)} SELECT host, snapshot_id AS id, ts, {PIVOT_COLUMNS}, "
    "CAST(max(CASE WHEN n = 'open_tables' THEN number END) AS BIGINT) AS open_tables, "
    + ", ".join(f"CAST(max(CASE WHEN n = 'seen_{e}' THEN number END) AS BIGINT) AS seen_{e}" for e in SEEN)
    + "".join(f", CAST(max(CASE WHEN n = '{c}' THEN number END) AS VARCHAR) AS {c}" for c in ("very_large", "max_join_size"))
    + " FROM numbers GROUP BY host, snapshot_id, ts",
)
def a2_observed(spark, sf):
    """All names that occur, those the catalogue does not know too."""
    entries = ", ".join(f"struct('{k}' AS kind, {n} AS name, {v} AS value)" for k, n, v in STRANGE)
    strange = table(spark, sf, "events").selectExpr(f"{HOST} AS host", "event_id AS snapshot_id", "ts", f"inline(array({entries}))")
    samples = snapshot_to_samples(raw_rows(spark, sf).unionByName(strange), CAT, expected=[])
    return samples.withColumns({c: F.col(c).cast("string") for c, t in samples.dtypes if t == "decimal(20,0)"})


@FAMILY.add("a3_name_filter", f"WITH {CLEAN_SQL} SELECT host, snapshot_id, kind, n AS name FROM kept")
def a3(spark, sf):
    return wanted(raw_rows(spark, sf), CAT).select("host", "snapshot_id", "kind", "name")


@FAMILY.add(
    "a4_value_normalise",
    f"WITH {CLEAN_SQL} SELECT host, snapshot_id, n AS name, CAST(number AS VARCHAR) AS number FROM numbers",
)
def a4(spark, sf):
    rows = wanted(raw_rows(spark, sf), CAT)
    number = normalize_value(F.col("name"), F.col("value"))
    return rows.select("host", "snapshot_id", "name", number.cast("string").alias("number"))


EXPECTED = ["queries", "innodb_rows_read", "custom_1", "custom_1_time", "relay_log_space", "os_cpu_user"]


@FAMILY.add(
    "a5_expected_columns",
    f"WITH {CLEAN_SQL} SELECT host, snapshot_id AS id, ts, CAST(max(CASE WHEN n = 'com_select' THEN number END) AS BIGINT) "
    "AS com_select" + "".join(f", CAST(NULL AS BIGINT) AS {c}" for c in EXPECTED)
    + " FROM numbers WHERE n = 'com_select' GROUP BY host, snapshot_id, ts",
)
def a5(spark, sf):
    return snapshot_to_samples(raw_rows(spark, sf), CAT, ["com_select"], expected=["com_select", *EXPECTED])


@FAMILY.add(
    "a6_binlog_number",
    f"WITH {RAW_SQL} SELECT host, snapshot_id, value, TRY_CAST(split_part(value, '.', -1) AS INTEGER) AS file_number "
    "FROM raw WHERE kind = 'master' AND name = 'File'",
)
def a6(spark, sf):
    rows = raw_rows(spark, sf).where("kind = 'master' AND name = 'File'")
    return rows.select("host", "snapshot_id", "value", binlog_number(F.col("value")).alias("file_number"))


SLAVE = ("read_master_log_pos", "relay_log_pos", "exec_master_log_pos", "relay_log_space", "seconds_behind_master")


@FAMILY.add(
    "a7_replication_fields",
    f"WITH {CLEAN_SQL}, r AS (SELECT host, snapshot_id, "
    "max(CASE WHEN kind = 'master' AND n = 'position' THEN TRY_CAST(v AS BIGINT) END) AS master_status_position, "
    "CAST(max(CASE WHEN kind = 'master' AND n = 'file' THEN TRY_CAST(split_part(v, '.', -1) AS BIGINT) END) AS BIGINT) "
    "AS master_status_file_number"
    + "".join(f", max(CASE WHEN kind = 'slave' AND n = '{c}' THEN TRY_CAST(v AS BIGINT) END) AS {c}" for c in SLAVE)
    + " FROM clean GROUP BY host, snapshot_id) SELECT s.host AS host, s.id AS id, s.ts AS ts, com_select, "
    "master_status_position, master_status_file_number, " + ", ".join(SLAVE)
    + " FROM (SELECT host, snapshot_id AS id, ts, CAST(max(number) AS BIGINT) AS com_select FROM numbers "
    "WHERE n = 'com_select' GROUP BY ALL) s LEFT JOIN r ON r.host = s.host AND r.snapshot_id = s.id",
)
def a7(spark, sf):
    raw = raw_rows(spark, sf)
    samples = snapshot_to_samples(raw, CAT, ["com_select"], expected=[])
    return with_replication(samples, replication_fields(raw))


# Collected text lines: (file, line number, text).
LINES = (
    ("stat", 0, "concat('cpu  ', CAST(event_id * 3 AS STRING), ' ', CAST(event_id AS STRING), ' ', "
                "CAST(event_id * 2 AS STRING), ' ', CAST(event_id * 5 AS STRING), ' 0 0')"),
    ("stat", 1, "'cpu0 1 2 3 4'"),
    ("stat", 2, "CASE WHEN event_id % 2 = 0 THEN 'cpu1 1 2 3 4' ELSE 'cpux 1 2' END"),
    ("stat", 3, "'intr 7 8 9'"),
    ("loadavg", 0, "concat(CAST(CAST(value AS DECIMAL(10,2)) AS STRING), ' 0.10 0.20 1/100 500')"),
    ("meminfo", 0, "'MemTotal:       16000000 kB'"),
    ("meminfo", 1, "concat('MemFree:  ', CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING), ' kB')"),
    ("meminfo", 2, "concat('Active:  ', CAST(event_id AS STRING), ' kB')"),
    ("meminfo", 3, "'Active(anon):  77 kB'"),
    ("meminfo", 4, "'SwapTotal: 2000000 kB'"),
    ("meminfo", 5, "'SwapFree: 1500000 kB'"),
    ("vmstat", 0, "concat('pgpgin ', CAST(event_id * 4 AS STRING))"),
    ("vmstat", 1, "concat('pgpgout ', CAST(event_id * 6 AS STRING))"),
    ("vmstat", 2, "concat('pswpin ', CAST(event_id % 9 AS STRING))"),
    ("vmstat", 3, "'pswpout 0'"),
    ("vmstat", 4, "'pgfault 99'"),
)


@FAMILY.add(
    "a8_os_facts",
    "SELECT concat('m', CAST(event_id AS STRING)) AS host, ts, "
    "event_id * 3 AS os_cpu_user, event_id AS os_cpu_nice, event_id * 2 AS os_cpu_system, event_id * 5 AS os_cpu_idle, "
    "CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS os_total_cpu_cores, "
    "CAST(trunc(CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) * 1000) AS BIGINT) AS os_loadavg_millis, "
    "CAST(16000000 AS BIGINT) AS os_mem_total_kb, CAST(floor(value * 1000) AS BIGINT) AS os_mem_free_kb, "
    "event_id AS os_mem_active_kb, CAST(2000000 AS BIGINT) AS os_swap_total_kb, CAST(1500000 AS BIGINT) AS os_swap_free_kb, "
    "event_id * 4 AS os_page_ins, event_id * 6 AS os_page_outs, event_id % 9 AS os_swap_ins, CAST(0 AS BIGINT) AS os_swap_outs "
    "FROM events",
)
def a8(spark, sf):
    entries = ", ".join(f"struct('{f}' AS file, {n} AS line_no, {t} AS line)" for f, n, t in LINES)
    lines = table(spark, sf, "events").selectExpr(
        "concat('m', CAST(event_id AS STRING)) AS host", "ts", f"inline(array({entries}))")
    return os_samples(lines)


MOUNTS = (("root", "1000 + event_id % 500", "CAST(floor(value) AS BIGINT)", "CAST(floor(value) AS BIGINT) + event_id % 40"),
          ("datadir", "event_id % 3", "event_id % 3", "event_id % 2"),
          ("tmpdir", "5000", "event_id % 5001", "event_id % 4000"))


@FAMILY.add(
    "a9_mount_usage",
    "WITH m AS (" + " UNION ALL ".join(
        f"SELECT event_id, ts, '{m}' AS mount, ({b}) - ({f}) AS used, {a} AS avail FROM events" for m, b, f, a in MOUNTS
    ) + "), u AS (SELECT *, CAST(ceil(100 * used / nullif(used + avail, 0)) AS BIGINT) AS usage FROM m) "
    "SELECT concat('m', CAST(event_id AS STRING)) AS host, ts"
    + "".join(f", max(CASE WHEN mount = '{m}' THEN usage END) AS os_{m}_mountpoint_usage_percent" for m, *_ in MOUNTS)
    + " FROM u GROUP BY event_id, ts",
)
def a9(spark, sf):
    entries = ", ".join(
        f"struct('{m}' AS mount, CAST({b} AS BIGINT) AS blocks, CAST({f} AS BIGINT) AS bfree, CAST({a} AS BIGINT) AS bavail)"
        for m, b, f, a in MOUNTS)
    rows = table(spark, sf, "events").selectExpr(
        "concat('m', CAST(event_id AS STRING)) AS host", "ts", f"inline(array({entries}))")
    return mount_samples(rows)


@FAMILY.add("a10_first_per_second", f"WITH {samples_sql(['com_select'])} SELECT * FROM samples")
def a10(spark, sf):
    return first_per_second(raw_samples(spark, sf, ["com_select"]))


@FAMILY.add(
    "a10_idempotent_append",
    f"WITH {samples_sql(['com_select'])} SELECT * FROM samples WHERE ts >= TIMESTAMP '2024-01-10'",
)
def a10_append(spark, sf):
    stored = ev_samples(spark, sf, []).where("ts < TIMESTAMP_NTZ '2024-01-10'")
    return append_samples(raw_samples(spark, sf, ["com_select"]), stored)


@FAMILY.add(
    "a14_schema_alignment",
    f"WITH {samples_sql(['com_select', 'custom_1', 'custom_1_time'])} SELECT host, id, ts, com_select, custom_1, "
    "custom_1_time, CAST(NULL AS BIGINT) AS custom_3, CAST(NULL AS BIGINT) AS queries FROM samples",
)
def a14(spark, sf):
    stored = ev_samples(spark, sf, ["com_select", "custom_1", "custom_1_time", "custom_2", "custom_2_time"])
    narrow = stored.withColumn("com_select", F.col("com_select").cast("int"))
    cat = MetricCatalog(custom_ids=(1, 3))
    return align_schema(narrow, cat, ["com_select", "custom_1", "custom_1_time", "custom_3", "queries"])


@FAMILY.add(
    "a14_rollup_alignment",
    f"WITH {samples_sql(['com_select'])} SELECT *, CAST(NULL AS BIGINT) AS com_select_diff, CAST(NULL AS BIGINT) AS uptime, "
    "CAST(NULL AS BIGINT) AS uptime_diff FROM samples",
)
def a14_rollup(spark, sf):
    return align_rollup(ev_samples(spark, sf, ["com_select"]), CAT, ["com_select", "uptime"])


@FAMILY.add(
    "a15_multi_host_union",
    f"WITH {samples_sql(['com_select', 'uptime'])} SELECT host, id, ts, com_select, "
    "CASE WHEN host = 'h0' THEN NULL ELSE uptime END AS uptime FROM samples",
)
def a15(spark, sf):
    samples = ev_samples(spark, sf, ["com_select", "uptime"])
    tables = {h: samples.where(F.col("host") == h).drop("host") for h in ("h0", "h3", "h4", "h5", "h6", "h7")}
    tables["h0"] = tables["h0"].drop("uptime")
    return union_hosts(tables)


@FAMILY.add(
    "a15_one_scan",
    f"WITH {samples_sql(['com_select', 'uptime'])} SELECT host, id, ts, com_select, uptime, CAST(NULL AS BIGINT) AS never_measured FROM samples",
)
def a15_scan(spark, sf):
    """A folder for each host, read in one scan."""
    root = scratch_dir(spark, "hosts")
    ev_samples(spark, sf, ["com_select", "uptime"]).write.partitionBy("host").parquet(root)
    return read_hosts(spark, root, "id long, ts timestamp_ntz, com_select long, uptime long, never_measured long")
