"""Recent windows, gap-free series, ticks, titles and reshaping."""

from pyspark.sql import functions as F

from gaugeweave.catalog import DAY, HOUR, SAMPLE
from gaugeweave.checks.fixtures import AS_OF, CAT, as_of, ev_samples, table
from gaugeweave.checks.oracle import delta_sql, report_sql, rollup_select, samples_sql, units
from gaugeweave.checks.registry import Family
from gaugeweave.checks.report_queries import grain_report
from gaugeweave.checks.rollup_queries import (
    REGISTRY_SQL,
    TEN,
    averages_sql,
    minmax_columns,
    sample_report,
    supplier_registry,
)
from gaugeweave.functions.timefn import NTZ, floor_day, floor_hour, floor_minutes, floor_monday
from gaugeweave.operators.delta import delta, latest
from gaugeweave.operators.report import digits_of
from gaugeweave.operators.reshape import custom_charts, custom_flat, custom_query_id, custom_registry, to_long
from gaugeweave.operators.rollup import bucket_avg, minmax, rollup
from gaugeweave.operators.series import axis_labels, fill_gaps, is_stale, recent, ticks

FAMILY = Family()
NAMES = ["com_select_psec", "threads_connected", "uptime_percent"]
DIGITS = digits_of(NAMES)

LATEST_SQL = "latest AS (SELECT host, max(id) AS id_latest, max(ts) AS ts_latest FROM samples GROUP BY host)"
TEN_OF = "time_bucket(INTERVAL '10 minutes', {0}, TIMESTAMP '2000-01-01')"
SINCE = {
    "sample": TEN_OF.format("ts_latest") + " - INTERVAL 24 HOUR",
    "hour": "ts_latest - INTERVAL 10 DAY",
    "day": "ts_latest - INTERVAL 1 YEAR",
}


def recent_sql(grain, names=NAMES):
    return (
        f"{report_sql(names, grain)}, {LATEST_SQL}, recent AS (SELECT report.*, id_latest, ts_latest FROM report "
        f"JOIN latest USING (host) WHERE CAST(ts AS TIMESTAMP) >= {SINCE[grain]})"
    )


def report_of(spark, sf, grain, names=NAMES):
    if grain.name == "sample":
        return sample_report(spark, sf, names)
    return grain_report(spark, sf, names, grain)


def recent_of(spark, sf, grain, names=NAMES):
    return recent(report_of(spark, sf, grain, names), latest(ev_samples(spark, sf, [])), grain)


def _register_recent(key, grain):
    @FAMILY.add(key, f"WITH {recent_sql(grain.name)} SELECT * FROM recent")
    def query(spark, sf):
        return recent_of(spark, sf, grain)


_register_recent("d1_recent_samples", SAMPLE)
_register_recent("d2_recent_hours", HOUR)
_register_recent("d3_recent_days", DAY)


# Orders as day samples over several years: one host per priority, so the yearly window cuts.
def order_days(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("host"), F.to_date("o_orderdate").alias("ts")
    ).agg(F.min("o_orderkey").alias("id"), F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("top_price"))


ORDER_DAYS = (
    "days AS (SELECT o_orderpriority AS host, CAST(o_orderdate AS DATE) AS ts, min(o_orderkey) AS id, "
    "count(*) AS orders, max(o_totalprice) AS top_price FROM orders GROUP BY ALL), "
    "latest AS (SELECT host, max(id) AS id_latest, CAST(max(ts) AS TIMESTAMP) AS ts_latest FROM days GROUP BY host), "
    "recent AS (SELECT days.*, id_latest, ts_latest FROM days JOIN latest USING (host) "
    "WHERE CAST(ts AS TIMESTAMP) >= ts_latest - INTERVAL 1 YEAR)"
)


def recent_order_days(spark, sf):
    days = order_days(spark, sf)
    newest = days.groupBy("host").agg(
        F.max("id").alias("id_latest"), F.max("ts").cast(NTZ).alias("ts_latest")
    )
    return recent(days, newest, DAY)


@FAMILY.add("d3_recent_year_of_orders", f"WITH {ORDER_DAYS} SELECT * FROM recent")
def d3_orders(spark, sf):
    return recent_order_days(spark, sf)


def ten_sql(names=NAMES):
    return (
        f"{recent_sql('sample', names)}, ten AS (SELECT host, {TEN} AS t, max(id) AS id{averages_sql(names)} "
        f"FROM recent GROUP BY host, {TEN}), buckets AS (SELECT *, t AS ts FROM ten)"
    )


def recent_buckets(spark, sf, grain, names=NAMES):
    rows = recent_of(spark, sf, grain, names)
    return bucket_avg(rows, digits_of(names, CAT.custom_ids)) if grain.name == "sample" else rows


def buckets_sql(grain, names=NAMES):
    return ten_sql(names) if grain == "sample" else f"{recent_sql(grain, names)}, buckets AS (SELECT * FROM recent)"


STEP = {"sample": "INTERVAL 10 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def filled_ctes(grain, names=NAMES):
    """CTE ``filled``: numbers joined to the span of each host, then to the buckets."""
    listed = "".join(f', b."{n}" AS "{n}"' for n in ["id", *names])
    return (
        f"{buckets_sql(grain, names)}, span AS (SELECT host, CAST(min(ts) AS TIMESTAMP) AS lo, "
        f"CAST(max(ts) AS TIMESTAMP) AS hi FROM buckets GROUP BY host), grid AS (SELECT host, "
        f"CAST(n AS INTEGER) AS timeseries_key, lo + n * {STEP[grain]} AS timeseries_ts, hi "
        f"FROM span, range(0, 4096) AS numbers(n) WHERE lo + n * {STEP[grain]} <= hi), "
        f"filled AS (SELECT grid.host AS host, timeseries_ts, timeseries_key{listed} FROM grid "
        "LEFT JOIN buckets b ON b.host = grid.host AND CAST(b.ts AS TIMESTAMP) = timeseries_ts)"
    )


def filled_of(spark, sf, grain, names=NAMES):
    return fill_gaps(recent_buckets(spark, sf, grain, names), grain, ["id", *names])


def _register_filled(key, grain):
    @FAMILY.add(key, f"WITH {filled_ctes(grain.name)} SELECT * FROM filled")
    def query(spark, sf):
        return filled_of(spark, sf, grain)


_register_filled("d4_gap_filled_ten_minutes", SAMPLE)
_register_filled("d5_gap_filled_hours", HOUR)
_register_filled("d6_gap_filled_days", DAY)


def summary_of(spark, sf, grain, names=NAMES):
    return minmax(recent_buckets(spark, sf, grain, names), names)


def summary_sql(grain, names=NAMES):
    """CTE ``summary``: span and ranges of the recent buckets."""
    return (
        f"{buckets_sql(grain, names)}, summary AS (SELECT host, CAST(min(ts) AS TIMESTAMP) AS ts_min, "
        f"CAST(max(ts) AS TIMESTAMP) AS ts_max{minmax_columns(names)} FROM buckets GROUP BY host)"
    )


BASE = {
    "sample": "date_trunc('hour', ts_min)",
    "hour": "date_trunc('day', ts_min)",
    "day": "date_trunc('week', ts_min)",
}
UNIT = {"sample": ("INTERVAL 1 HOUR", 24), "hour": ("INTERVAL 1 DAY", 10), "day": ("INTERVAL 7 DAY", 52)}


def ticks_sql(grain, source="summary"):
    unit, limit = UNIT[grain]
    return (
        f"tick AS (SELECT host, ts_min, ts_max, CAST(n AS INTEGER) AS n, {BASE[grain]} + n * {unit} AS tick_ts "
        f"FROM {source}, range(0, {limit + 1}) AS numbers(n) "
        f"WHERE {BASE[grain]} + n * {unit} BETWEEN ts_min AND ts_max)"
    )


ORDER_SUMMARY = (
    f"{ORDER_DAYS}, summary AS (SELECT host, CAST(min(ts) AS TIMESTAMP) AS ts_min, "
    "CAST(max(ts) AS TIMESTAMP) AS ts_max FROM recent GROUP BY host)"
)


def order_summary(spark, sf):
    return minmax(recent_order_days(spark, sf), ["orders"])


def _tick_queries(key, grain, of, ctes):
    @FAMILY.add(f"d7_ticks_{key}", f"WITH {ctes}, {ticks_sql(grain.name)} SELECT host, n, tick_ts FROM tick")
    def tick_query(spark, sf):
        return ticks(of(spark, sf), grain)


_tick_queries("sample", SAMPLE, lambda s, d: summary_of(s, d, SAMPLE), summary_sql("sample"))
_tick_queries("hour", HOUR, lambda s, d: summary_of(s, d, HOUR), summary_sql("hour"))
_tick_queries("week", DAY, order_summary, ORDER_SUMMARY)

ORDINAL = (
    "CAST(day(tick_ts) AS VARCHAR) || CASE WHEN day(tick_ts) IN (11, 12, 13) THEN 'th' WHEN day(tick_ts) % 10 = 1 THEN 'st' "
    "WHEN day(tick_ts) % 10 = 2 THEN 'nd' WHEN day(tick_ts) % 10 = 3 THEN 'rd' ELSE 'th' END"
)
LABEL = {
    "sample": "CASE hour(tick_ts) % 4 WHEN 0 THEN strftime(tick_ts, '%H:00') WHEN 2 THEN ' ' ELSE '' END",
    "hour": ORDINAL,
    "day": "lower(strftime(tick_ts, '%b %-d'))",
}
SPAN_UNIT = {"sample": "minute", "hour": "hour", "day": "day"}
LEAD = {
    "sample": "(60 - minute(ts_min)) % 60",
    "hour": "(24 - hour(ts_min)) % 24",
    "day": "(7 - (isodow(ts_min) - 1)) % 7",
}
PER = {"sample": 60, "hour": 24, "day": 7}
SHAPE = {"sample": "%b %-d, %H:%M", "hour": "%b %-d, %H:00", "day": "%b %-d, %Y"}
STALE = {"sample": "INTERVAL 1 HOUR", "hour": "INTERVAL 2 HOUR", "day": "INTERVAL 1 DAY"}


def labels_sql(grain, at=AS_OF):
    """CTE ``labels`` from ``summary``."""
    span = f"date_sub('{SPAN_UNIT[grain]}', ts_min, ts_max)"
    step = units(str(PER[grain] * 100), span, 100)
    offset = units(f"({LEAD[grain]} * 100)", span, 100)
    two = lambda x: f"CAST(CAST(CAST({x} AS DOUBLE) / 100 AS DECIMAL(24,2)) AS VARCHAR)"
    stale = f"ts_max < TIMESTAMP '{at}' - {STALE[grain]}"
    length = units(span, "60", 1) if grain == "sample" else units("date_sub('hour', ts_min, ts_max)", "24", 1)
    unit = "hours" if grain == "sample" else "days"
    moved = f"(n - CASE WHEN {BASE[grain]} < ts_min THEN 1 ELSE 0 END)"
    return (
        f"{ticks_sql(grain)}, labels AS (SELECT host, coalesce({two(step)}, '') AS x_axis_step_size, "
        f"coalesce({two(offset)}, '') AS x_axis_offset, string_agg({LABEL[grain]}, '|' ORDER BY n) AS x_axis_labels, "
        f"coalesce(string_agg({two(f'({offset} + {step} * {moved})')}, ',' ORDER BY n), '') AS x_axis_labels_positions, "
        f"CASE WHEN {stale} THEN 'STALE DATA! ' ELSE 'Latest ' END || CAST({length} AS VARCHAR) || ' {unit}: ' || "
        f"strftime(ts_min, '{SHAPE[grain]}') || '  -  ' || strftime(ts_max, '{SHAPE[grain]}') AS chart_time_description, "
        f"{ {'sample': 600, 'hour': 3600, 'day': 86400}[grain] } AS ts_step_seconds, "
        f"CASE WHEN {stale} THEN '808080' ELSE '303030' END AS chart_title_color, "
        f"CASE WHEN {stale} THEN 'f0f0f0' ELSE 'ffffff' END AS chart_bg_color "
        "FROM tick GROUP BY host, ts_min, ts_max)"
    )


def _label_queries(key, grain, of, ctes):
    base = f"WITH {ctes}, {labels_sql(grain.name)} "

    @FAMILY.add(f"d8_labels_{key}", base + "SELECT host, x_axis_labels FROM labels")
    def labels(spark, sf):
        return axis_labels(of(spark, sf), grain, as_of()).select("host", "x_axis_labels")

    @FAMILY.add(f"d9_step_offset_{key}", base + "SELECT host, x_axis_step_size, x_axis_offset FROM labels")
    def step_offset(spark, sf):
        return axis_labels(of(spark, sf), grain, as_of()).select("host", "x_axis_step_size", "x_axis_offset")

    @FAMILY.add(f"d10_positions_{key}", base + "SELECT host, x_axis_labels_positions FROM labels")
    def positions(spark, sf):
        return axis_labels(of(spark, sf), grain, as_of()).select("host", "x_axis_labels_positions")


_label_queries("sample", SAMPLE, lambda s, d: summary_of(s, d, SAMPLE), summary_sql("sample"))
_label_queries("hour", HOUR, lambda s, d: summary_of(s, d, HOUR), summary_sql("hour"))
_label_queries("week", DAY, order_summary, ORDER_SUMMARY)


@FAMILY.add(
    "d11_titles",
    " UNION ALL ".join(
        f"(WITH {summary_sql(g)}, {labels_sql(g)} SELECT host, '{g}' AS grain, chart_time_description FROM labels)"
        for g in ("sample", "hour")
    ),
)
def d11(spark, sf):
    parts = [
        axis_labels(summary_of(spark, sf, g), g, as_of()).select(
            "host", F.lit(g.name).alias("grain"), "chart_time_description")
        for g in (SAMPLE, HOUR)
    ]
    return parts[0].union(parts[1])


@FAMILY.add(
    "d12_staleness",
    f"WITH {samples_sql([])}, s AS (SELECT host, max(ts) AS ts_max FROM samples GROUP BY host) SELECT host, "
    + ", ".join(f"ts_max < TIMESTAMP '{AS_OF}' - {i} AS stale_{g}" for g, i in STALE.items())
    + " FROM s",
)
def d12(spark, sf):
    newest = ev_samples(spark, sf, []).groupBy("host").agg(F.max("ts").alias("ts_max"))
    return newest.select("host", *[is_stale(as_of(), g).alias(f"stale_{g.name}") for g in (SAMPLE, HOUR, DAY)])


@FAMILY.add(
    "d13_time_floors",
    f"SELECT event_id, {TEN} AS ten, date_trunc('hour', ts) AS hour, date_trunc('day', ts) AS day, "
    "CAST(date_trunc('week', ts) AS TIMESTAMP) AS monday FROM events",
)
def d13(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", floor_minutes(ts, 10).alias("ten"), floor_hour(ts).alias("hour"), floor_day(ts).alias("day"),
        floor_monday(ts).alias("monday"))


LONG_METRICS = ["com_select", "threads_connected"]
LONG = [*LONG_METRICS, "max_connections", *[f"{m}_diff" for m in LONG_METRICS], *[f"{m}_psec" for m in LONG_METRICS]]


@FAMILY.add(
    "e1_unpivot",
    f"WITH {delta_sql(LONG_METRICS, ['max_connections'])}, rolled AS ("
    f"{rollup_select('hour', LONG_METRICS, ['max_connections'], rate_mode='ratio')}) "
    + " UNION ALL ".join(
        f"SELECT host, id, ts, '{c}' AS variable_name, CAST(trunc({c}) AS BIGINT) AS variable_value FROM rolled"
        for c in LONG
    ),
)
def e1(spark, sf):
    samples = ev_samples(spark, sf, [*LONG_METRICS, "max_connections"])
    hours = rollup(delta(samples, CAT, LONG_METRICS, ["max_connections"]), HOUR, LONG_METRICS, ["max_connections"], "ratio")
    return to_long(hours, LONG)


# Supplier texts stand in for stored payloads: those of the enabled queries.
CHARTS_SQL = (
    "charts AS (SELECT DISTINCT host, concat('custom_', CAST(custom_query_id AS STRING), "
    "CASE chart_type WHEN 'value_psec' THEN '_psec' WHEN 'time' THEN '_time' ELSE '' END) AS alias, "
    "concat('s:', description) AS chart, concat('t:', description) AS chart_extended FROM registry WHERE enabled)"
)
NAME_SQL = (
    "CASE chart_type WHEN 'value' THEN 'custom_' || custom_query_id WHEN 'value_psec' THEN "
    "'custom_' || custom_query_id || '_psec' WHEN 'time' THEN 'custom_' || custom_query_id || '_time' END"
)


def supplier_charts(spark, sf):
    suffix = "CASE chart_type WHEN 'value_psec' THEN '_psec' WHEN 'time' THEN '_time' ELSE '' END"
    return supplier_registry(spark, sf).where("enabled").selectExpr(
        "host", f"concat('custom_', custom_query_id, {suffix}) AS alias",
        "concat('s:', description) AS chart", "concat('t:', description) AS chart_extended")


FLAT_IDS = [1, 2, 4, 5, 6]


@FAMILY.add(
    "e2_custom_flat",
    f"WITH {REGISTRY_SQL}, {CHARTS_SQL}, c AS (SELECT registry.*, alias AS chart_name, chart, chart_extended "
    f"FROM registry LEFT JOIN charts ON charts.host = registry.host AND alias = {NAME_SQL} WHERE chart_type <> 'none'), "
    f"n AS (SELECT *, {NAME_SQL} AS name FROM c) SELECT host"
    + "".join(
        f", max(CASE WHEN custom_query_id = {i} AND enabled THEN chart END) AS custom_{i}_chart"
        f", max(CASE WHEN custom_query_id = {i} AND enabled THEN chart_extended END) AS custom_{i}_chart_extended"
        f", max(CASE WHEN custom_query_id = {i} THEN name END) AS custom_{i}_chart_name"
        f", max(CASE WHEN custom_query_id = {i} THEN description END) AS custom_{i}_text_description"
        f", max(CASE WHEN custom_query_id = {i} THEN description || ' [' || chart_type || ']' END) AS custom_{i}_description"
        for i in FLAT_IDS
    )
    + " FROM n GROUP BY host",
)
def e2(spark, sf):
    return custom_flat(custom_charts(supplier_registry(spark, sf), supplier_charts(spark, sf)), FLAT_IDS)


@FAMILY.add(
    "e3_custom_chart",
    f"WITH {REGISTRY_SQL}, {CHARTS_SQL} SELECT registry.host AS host, custom_query_id, {NAME_SQL} AS chart_name, chart, "
    f"chart_extended FROM registry LEFT JOIN charts ON charts.host = registry.host AND alias = {NAME_SQL} "
    "WHERE chart_type <> 'none'",
)
def e3(spark, sf):
    charts = custom_charts(supplier_registry(spark, sf), supplier_charts(spark, sf))
    return charts.select("host", "custom_query_id", "chart_name", "chart", "chart_extended")


@FAMILY.add(
    "e4_chart_name",
    f"WITH {REGISTRY_SQL} SELECT *, {NAME_SQL} AS chart_name, "
    "CAST(CASE chart_type WHEN 'none' THEN 0 ELSE 1 END AS INTEGER) AS chart_enabled FROM registry",
)
def e4(spark, sf):
    return custom_registry(supplier_registry(spark, sf))


@FAMILY.add(
    "e5_custom_query_id",
    "WITH names AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('custom_', CAST(s_suppkey AS STRING)) "
    "WHEN 1 THEN concat('custom_', CAST(s_suppkey AS STRING), '_time') WHEN 2 THEN 'custom_' ELSE s_name END AS c "
    "FROM supplier) SELECT s_suppkey, c, CAST(nullif(regexp_extract(c, '^custom_([0-9]+)(_.+)?$', 1), '') AS INTEGER) "
    "AS custom_query_id FROM names",
)
def e5(spark, sf):
    name = (
        "CASE s_suppkey % 4 WHEN 0 THEN concat('custom_', s_suppkey) WHEN 1 THEN concat('custom_', s_suppkey, '_time') "
        "WHEN 2 THEN 'custom_' ELSE s_name END AS c"
    )
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey", name)
    return rows.withColumn("custom_query_id", custom_query_id(F.col("c")))
