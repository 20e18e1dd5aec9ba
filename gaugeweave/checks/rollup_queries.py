"""Rollups, refresh, profiles and summaries."""

from pyspark.sql import functions as F

from gaugeweave.catalog import DAY, HOUR
from gaugeweave.checks.fixtures import CAT, ev_samples, table
from gaugeweave.checks.oracle import bucket, delta_sql, mean, report_sql, rollup_select
from gaugeweave.checks.registry import Family
from gaugeweave.functions.numeric import round_digits
from gaugeweave.functions.text import joined
from gaugeweave.operators.delta import delta, rates
from gaugeweave.operators.report import digits_of, inputs_of, report
from gaugeweave.operators.reshape import history, registry_fingerprint
from gaugeweave.operators.rollup import (
    backfill,
    bucket_avg,
    buckets_of,
    latest_rows,
    minmax,
    missing_buckets,
    profile_24_7,
    refresh,
    replace_buckets,
    rollup,
)
from gaugeweave.operators.states import averages, missing_hours, note_hours, profile_of, ranges_of, refresh_states
from gaugeweave.session import materialize, scratch_dir
from gaugeweave.sources.tables import read_table, rebuild_buckets, upsert_buckets

FAMILY = Family()
METRICS = ["com_select", "uptime", "threads_connected", "bytes_sent"]
PARAMS = ["max_connections", "table_cache"]
GRAIN = {"hour": HOUR, "day": DAY}


def deltas(spark, sf, metrics=METRICS, params=PARAMS):
    return delta(ev_samples(spark, sf, [*metrics, *params]), CAT, metrics, params)


DELTA = delta_sql(METRICS, PARAMS)


def sample_report(spark, sf, names):
    needs = inputs_of(names, CAT)
    samples = ev_samples(spark, sf, [*needs.metrics, *needs.params])
    return report(rates(delta(samples, CAT, needs.metrics, needs.params), needs.rates), names, CAT)


@FAMILY.add("c1_hour_rollup_mean", f"WITH {DELTA} {rollup_select('hour', METRICS, PARAMS, rate_mode='mean')}")
def c1(spark, sf):
    return rollup(deltas(spark, sf), HOUR, METRICS, PARAMS, "mean")


@FAMILY.add("c2_day_rollup_mean", f"WITH {DELTA} {rollup_select('day', METRICS, PARAMS, rate_mode='mean')}")
def c2(spark, sf):
    return rollup(deltas(spark, sf), DAY, METRICS, PARAMS, "mean")


@FAMILY.add("c3_hour_rollup", f"WITH {DELTA} {rollup_select('hour', METRICS, PARAMS, rate_mode='ratio')}")
def c3(spark, sf):
    return rollup(deltas(spark, sf), HOUR, METRICS, PARAMS, "ratio")


@FAMILY.add("c4_day_rollup", f"WITH {DELTA} {rollup_select('day', METRICS, PARAMS, rate_mode='ratio')}")
def c4(spark, sf):
    return rollup(deltas(spark, sf), DAY, METRICS, PARAMS, "ratio")


# The bucket of the newest sample of each host, as after each collection.
NEWEST = f"(host, {bucket('hour')}) IN (SELECT host, date_trunc('hour', max(ts)) FROM samples GROUP BY host)"


@FAMILY.add(
    "c5_refresh_newest_hour", f"WITH {DELTA} {rollup_select('hour', METRICS, PARAMS, where='WHERE ' + NEWEST)}"
)
def c5(spark, sf):
    samples = ev_samples(spark, sf, [*METRICS, *PARAMS])
    newest = buckets_of(samples.groupBy("host").agg(F.max("ts").alias("ts")), HOUR)
    return refresh(delta(samples, CAT, METRICS, PARAMS), newest, HOUR, METRICS, PARAMS)


# A rollup table as an outage leaves it: nothing written since a day, and one hour missed every night.
WRITTEN = "ts < TIMESTAMP '2024-01-25' AND hour(ts) <> 3"


def _partial(spark, sf):
    return rollup(deltas(spark, sf), HOUR, METRICS, PARAMS).where(WRITTEN.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


MISSING = (
    f"WITH {DELTA}, rolled AS ({rollup_select('hour', METRICS, PARAMS)}) "
    f"SELECT DISTINCT d.host AS host, date_trunc('hour', d.ts) AS ts FROM delta d LEFT JOIN "
    f"(SELECT * FROM rolled WHERE {WRITTEN}) r ON r.host = d.host AND r.ts = date_trunc('hour', d.ts) "
    "WHERE r.id IS NULL"
)


@FAMILY.add(
    "c6_missing_hours",
    MISSING,
)
def c6(spark, sf):
    return missing_buckets(deltas(spark, sf), _partial(spark, sf), HOUR)


@FAMILY.add(
    "c7_backfill",
    f"WITH {DELTA}, rolled AS ({rollup_select('hour', METRICS, PARAMS)}) SELECT * FROM rolled WHERE NOT ({WRITTEN})",
)
def c7(spark, sf):
    return backfill(deltas(spark, sf), _partial(spark, sf), HOUR, METRICS, PARAMS)


def _missing_by_mask(spark, changes):
    """Masks stored beside samples and rollup, each in two batches of rows in any order, one of them repeated."""
    paths = []
    for rows in (changes.select("host", "id", "ts"), rollup(changes, HOUR, METRICS, PARAMS).where(WRITTEN.replace("TIMESTAMP", "TIMESTAMP_NTZ"))):
        path = scratch_dir(spark, "masks")
        for part in (0, 1, 0):
            note_hours(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path, shards=2)
        paths.append(path)
    return missing_hours(*[read_table(spark, p) for p in paths])


@FAMILY.add("c6_missing_by_mask", MISSING)
def c6_mask(spark, sf):
    return _missing_by_mask(spark, materialize(deltas(spark, sf), "changes"))


@FAMILY.add(
    "c7_backfill_by_mask",
    f"WITH {DELTA}, rolled AS ({rollup_select('hour', METRICS, PARAMS)}) SELECT * FROM rolled WHERE NOT ({WRITTEN})",
)
def c7_mask(spark, sf):
    changes = materialize(deltas(spark, sf), "changes")
    return refresh(changes, _missing_by_mask(spark, changes), HOUR, METRICS, PARAMS)


@FAMILY.add("c8_full_rebuild", f"WITH {DELTA} {rollup_select('day', METRICS, PARAMS)}")
def c8(spark, sf):
    path = scratch_dir(spark, "rebuild")
    changes = deltas(spark, sf)
    rebuild_buckets(changes.where("host = 'h0'"), path, DAY, METRICS, PARAMS, shards=2)
    rebuild_buckets(changes, path, DAY, METRICS, PARAMS, shards=2)
    return read_table(spark, path)


AVERAGED = ["com_select_psec", "threads_connected", "uptime_percent", "mega_bytes_sent_psec"]
DIGITS = digits_of(AVERAGED)
TEN = "time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '2000-01-01')"


def averages_sql(names):
    d = digits_of(names, CAT.custom_ids)
    return "".join(f', {mean(n, d[n])} AS "{n}"' for n in names)


def stored_states(spark, sf):
    """Parts of ten minutes of a table that grew: the later half of its rows falls into slots that are stored already."""
    path = scratch_dir(spark, "states")
    rows = materialize(sample_report(spark, sf, AVERAGED), "report")
    first = rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    refresh_states(first, first, DIGITS, path, shards=2)
    refresh_states(rows, rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 1), DIGITS, path, shards=2)
    return read_table(spark, path)


TEN_MINUTES = (
    f"WITH {report_sql(AVERAGED)} SELECT host, {TEN} AS ts, max(id) AS id{averages_sql(AVERAGED)} "
    f"FROM report GROUP BY host, {TEN}"
)


@FAMILY.add(
    "c9_ten_minute_average",
    TEN_MINUTES,
)
def c9(spark, sf):
    return bucket_avg(sample_report(spark, sf, AVERAGED), DIGITS)


@FAMILY.add("c9_from_states", TEN_MINUTES)
def c9_states(spark, sf):
    return averages(stored_states(spark, sf), DIGITS)


PROFILE = (
    f"WITH {report_sql(AVERAGED)} SELECT host, CAST(isodow(ts) - 1 AS INTEGER) AS wd, CAST(hour(ts) AS INTEGER) AS hr"
    f"{averages_sql(AVERAGED)} FROM report GROUP BY host, isodow(ts), hour(ts)"
)


@FAMILY.add(
    "c10_profile_24_7",
    PROFILE,
)
def c10(spark, sf):
    return profile_24_7(sample_report(spark, sf, AVERAGED), DIGITS)


@FAMILY.add("c10_from_states", PROFILE)
def c10_states(spark, sf):
    return profile_of(stored_states(spark, sf), DIGITS)


def minmax_columns(names, digits=True):
    text = ""
    for n in names:
        text += f', min("{n}") AS "{n}_min", max("{n}") AS "{n}_max"'
        if digits:
            text += (
                f', CAST(greatest(1, coalesce(ceil(-ln(nullif(CAST(max("{n}") - min("{n}") AS DOUBLE), 0))), 0)) '
                f'AS INTEGER) AS "{n}_round_digits"'
            )
    return text


SPAN = "count(*) AS count_rows, min(ts) AS ts_min, max(ts) AS ts_max, date_sub('second', min(ts), max(ts)) AS ts_diff_seconds"


RANGES = (
    f"WITH {report_sql(AVERAGED)}, ten AS (SELECT host, {TEN} AS t, max(id) AS id{averages_sql(AVERAGED)} "
    f"FROM report GROUP BY host, {TEN}), named AS (SELECT *, t AS ts FROM ten) "
    f"SELECT host, {SPAN}{minmax_columns(AVERAGED)} FROM named GROUP BY host"
)


@FAMILY.add(
    "c11_minmax",
    RANGES,
)
def c11(spark, sf):
    return minmax(bucket_avg(sample_report(spark, sf, AVERAGED), DIGITS), AVERAGED)


@FAMILY.add("c11_from_states", RANGES)
def c11_states(spark, sf):
    return ranges_of(stored_states(spark, sf), DIGITS)


@FAMILY.add(
    "c12_round_digits",
    "SELECT user_id, min(value) AS low, max(value) AS high, CAST(greatest(1, coalesce(ceil(-ln(nullif("
    "(max(value) - min(value)) / 10000, 0))), 0)) AS INTEGER) AS digits FROM events GROUP BY user_id",
)
def c12(spark, sf):
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return spans.select("*", round_digits(F.lit(0.0), (F.col("high") - F.col("low")) / 10000).alias("digits"))


@FAMILY.add(
    "c13_ordered_concat",
    f"WITH {DELTA}, rolled AS ({rollup_select('hour', METRICS, PARAMS)}) SELECT host, CAST(ts AS DATE) AS day, "
    "string_agg(hour(ts) || ':' || com_select_diff, '|' ORDER BY ts) AS changes FROM rolled GROUP BY host, CAST(ts AS DATE)",
)
def c13(spark, sf):
    hours = rollup(deltas(spark, sf), HOUR, METRICS, PARAMS)
    item = F.concat(F.hour("ts").cast("string"), F.lit(":"), F.col("com_select_diff").cast("string"))
    return hours.groupBy("host", F.to_date("ts").alias("day")).agg(joined(item, "|", F.col("ts")).alias("changes"))


# Suppliers as a registry of custom queries, one host per nation.
REGISTRY_COLUMNS = (
    "concat('n', CAST(s_nationkey AS STRING)) AS host",
    "CAST(s_suppkey AS INT) AS custom_query_id",
    "s_suppkey % 3 <> 0 AS enabled",
    "s_name AS description",
    "CASE s_suppkey % 4 WHEN 0 THEN 'value' WHEN 1 THEN 'value_psec' WHEN 2 THEN 'time' ELSE 'none' END AS chart_type",
    "CAST(s_suppkey % 7 AS INT) AS chart_order",
)
REGISTRY_SQL = f"registry AS (SELECT {', '.join(REGISTRY_COLUMNS)} FROM supplier)"


def supplier_registry(spark, sf):
    return table(spark, sf, "supplier").selectExpr(*REGISTRY_COLUMNS)


@FAMILY.add(
    "c14_registry_fingerprint",
    f"WITH {REGISTRY_SQL}, hosts AS (SELECT DISTINCT concat('n', CAST(c_nationkey AS STRING)) AS host FROM customer) "
    "SELECT hosts.host AS host, coalesce(string_agg(CAST(custom_query_id AS VARCHAR) || ':' || chart_type, ',' "
    "ORDER BY chart_order, custom_query_id), '') AS custom_queries "
    "FROM hosts LEFT JOIN registry USING (host) GROUP BY hosts.host",
)
def c14(spark, sf):
    hosts = table(spark, sf, "customer").selectExpr("concat('n', CAST(c_nationkey AS STRING)) AS host")
    return registry_fingerprint(supplier_registry(spark, sf), hosts)


STEP = "auto_increment_increment"
STEPPED = delta_sql(METRICS, PARAMS, f"greatest(1, coalesce(c.{STEP}, 1))", [STEP])


@FAMILY.add("c7_backfill_step_column", f"WITH {STEPPED} {rollup_select('hour', METRICS, PARAMS, where='WHERE hour(ts) % 3 = 1')}")
def c7_step(spark, sf):
    """Hours missing from a rollup, of samples whose numbering step differs from row to row."""
    changes = materialize(delta(ev_samples(spark, sf, [*METRICS, *PARAMS, STEP]), CAT, METRICS, PARAMS, step=STEP), "changes")
    stored = rollup(changes.where("hour(ts) % 3 <> 1"), HOUR, METRICS, PARAMS)
    return backfill(changes, stored, HOUR, METRICS, PARAMS)


KEPT = ["com_select", "threads_connected", "max_connections"]


@FAMILY.add(
    "c15_history",
    f"WITH {DELTA}, rolled AS ({rollup_select('hour', METRICS, PARAMS)}), long AS ("
    + " UNION ALL ".join(f"SELECT host, id, ts, '{n}' AS variable_name, {n} AS v FROM rolled" for n in KEPT)
    + ") SELECT host, variable_name, min(id) AS id, min(ts) AS min_ts, max(ts) AS max_ts, "
    "string_agg(CAST(v AS VARCHAR), ',' ORDER BY ts) AS variable_values FROM long GROUP BY host, variable_name",
)
def c15(spark, sf):
    return history(rollup(deltas(spark, sf), HOUR, METRICS, PARAMS), KEPT)


@FAMILY.add("c16_distinct_buckets", f"WITH {DELTA} SELECT DISTINCT host, CAST(ts AS DATE) AS ts FROM delta")
def c16(spark, sf):
    return buckets_of(deltas(spark, sf), DAY)


@FAMILY.add(
    "c17_latest_row",
    f"WITH {report_sql(AVERAGED)} SELECT * FROM report QUALIFY row_number() OVER (PARTITION BY host ORDER BY id DESC) = 1",
)
def c17(spark, sf):
    return latest_rows(sample_report(spark, sf, AVERAGED))


@FAMILY.add("a11_bucket_upsert", f"WITH {DELTA} {rollup_select('hour', METRICS, PARAMS)}")
def a11(spark, sf):
    """A table first written with wrong values, then upserted: the true rows replace them."""
    path = scratch_dir(spark, "upsert")
    right = rollup(deltas(spark, sf), HOUR, METRICS, PARAMS)
    wrong = right.withColumn("com_select", F.lit(-1).cast("long"))
    upsert_buckets(wrong, path, shards=2)
    upsert_buckets(right, path, shards=2)
    return read_table(spark, path)


@FAMILY.add(
    "a11_replace_buckets",
    f"WITH {DELTA}, rolled AS ({rollup_select('day', METRICS, PARAMS)}) SELECT host, id, ts, "
    "CASE WHEN ts >= DATE '2024-01-15' THEN com_select ELSE -1 END AS com_select FROM rolled",
)
def a11_replace(spark, sf):
    right = rollup(deltas(spark, sf), DAY, METRICS, PARAMS).select("host", "id", "ts", "com_select")
    old = right.withColumn("com_select", F.lit(-1).cast("long"))
    return replace_buckets(old, right.where("ts >= DATE '2024-01-15'"))
