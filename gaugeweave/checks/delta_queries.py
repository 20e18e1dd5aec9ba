"""Deltas, rates and parameter changes."""

from datetime import date

from pyspark.sql import functions as F

from gaugeweave.checks.fixtures import CAT, ev_samples
from gaugeweave.checks.oracle import delta_sql, rounded, sample_sql, samples_sql
from gaugeweave.checks.registry import Family
from gaugeweave.operators.delta import adjacent, delta, latest, param_changes, rates, samples_view
from gaugeweave.operators.states import NewestIndex
from gaugeweave.session import scratch_dir

FAMILY = Family()
BLOCK = 256  # small, so that the given tables cross many block edges

COUNTERS = ["com_select", "uptime", "com_replace"]
GAUGES = ["threads_connected", "seconds_behind_master", "relay_log_space"]
PARAMS = ["max_connections", "table_cache"]
STEP = "greatest(1, coalesce(c.auto_increment_increment, 1))"


@FAMILY.add(
    "b1_latest",
    f"WITH {samples_sql([])} SELECT host, max(id) AS id_latest, max(ts) AS ts_latest FROM samples GROUP BY host",
)
def b1(spark, sf):
    return latest(ev_samples(spark, sf, []))


@FAMILY.add(
    "b1_newest_index",
    f"WITH {samples_sql([])} SELECT host, max(id) AS id_latest, max(ts) AS ts_latest FROM samples GROUP BY host "
    "HAVING max(ts) >= DATE '2024-01-28'",
)
def b1_index(spark, sf):
    """The index after batches in any order, one repeated, and after a purge of the days before the 28th."""
    index = NewestIndex(scratch_dir(spark, "newest"), shards=4)
    samples = ev_samples(spark, sf, [])
    for part in (2, 0, 1, 0):
        index.note(samples.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part))
    index.retire(spark, date(2024, 1, 28))
    return index.table(spark)


@FAMILY.add(
    "b2_adjacent_pairs",
    f"WITH {samples_sql([])} SELECT c.host AS host, c.id AS id, p.id AS prev_id, c.ts AS ts, p.ts AS prev_ts "
    "FROM samples c JOIN samples p ON p.host = c.host AND p.id = c.id - 1",
)
def b2(spark, sf):
    samples = ev_samples(spark, sf, []).withColumn("number", F.col("id"))
    pairs = adjacent(samples, ["number"], block=BLOCK)
    return pairs.select("host", "id", F.col("prev_number").alias("prev_id"), "ts", "prev_ts")


@FAMILY.add(
    "b2_adjacent_pairs_constant_step",
    f"WITH {samples_sql([])} SELECT c.host AS host, c.id AS id, p.id AS prev_id "
    "FROM samples c JOIN samples p ON p.host = c.host AND p.id = c.id - 3",
)
def b2_constant(spark, sf):
    samples = ev_samples(spark, sf, []).withColumn("number", F.col("id"))
    return adjacent(samples, ["number"], step=3, block=BLOCK).select("host", "id", F.col("prev_number").alias("prev_id"))


@FAMILY.add(
    "b2_adjacent_pairs_step_column",
    f"WITH {samples_sql(['auto_increment_increment'])} SELECT c.host AS host, c.id AS id, p.id AS prev_id "
    f"FROM samples c JOIN samples p ON p.host = c.host AND p.id = c.id - {STEP}",
)
def b2_column(spark, sf):
    samples = ev_samples(spark, sf, ["auto_increment_increment"]).withColumn("number", F.col("id"))
    pairs = adjacent(samples, ["number"], step="auto_increment_increment")
    return pairs.select("host", "id", F.col("prev_number").alias("prev_id"))


@FAMILY.add("b3_elapsed_seconds", f"WITH {delta_sql([])} SELECT host, id, ts_diff_seconds FROM delta")
def b3(spark, sf):
    return delta(ev_samples(spark, sf, []), CAT, [], [], block=BLOCK).select("host", "id", "ts_diff_seconds")


@FAMILY.add(
    "b4_gauge_diff",
    f"WITH {delta_sql(GAUGES)} SELECT host, id, " + ", ".join(f"{g}_diff" for g in GAUGES) + " FROM delta",
)
def b4(spark, sf):
    d = delta(ev_samples(spark, sf, GAUGES), CAT, GAUGES, [], block=BLOCK)
    return d.select("host", "id", *[f"{g}_diff" for g in GAUGES])


@FAMILY.add(
    "b5_counter_diff",
    f"WITH {delta_sql(COUNTERS)} SELECT host, id, " + ", ".join(f"{c}, {c}_diff" for c in COUNTERS) + " FROM delta",
)
def b5(spark, sf):
    d = delta(ev_samples(spark, sf, COUNTERS), CAT, COUNTERS, [], block=BLOCK)
    return d.select("host", "id", *[x for c in COUNTERS for x in (c, f"{c}_diff")])


@FAMILY.add(
    "b6_null_diff",
    f"WITH {sample_sql(['queries', 'threads_connected'])} SELECT host, id, queries_diff, queries_psec, "
    "threads_connected_diff, threads_connected_psec FROM sv WHERE queries_diff IS NULL OR threads_connected_diff IS NULL",
)
def b6(spark, sf):
    names = ["queries", "threads_connected"]
    view = rates(delta(ev_samples(spark, sf, names), CAT, names, [], block=BLOCK), names)
    gone = F.col("queries_diff").isNull() | F.col("threads_connected_diff").isNull()
    return view.where(gone).select("host", "id", *[f"{n}_{s}" for n in names for s in ("diff", "psec")])


@FAMILY.add(
    "b7_rate",
    f"WITH {delta_sql(COUNTERS + GAUGES)} SELECT host, id"
    + "".join(f", {rounded(f'{c}_diff', 'ts_diff_seconds', 2)} AS {c}_psec" for c in COUNTERS + GAUGES)
    + " FROM delta",
)
def b7(spark, sf):
    names = COUNTERS + GAUGES
    view = rates(delta(ev_samples(spark, sf, names), CAT, names, [], block=BLOCK), names)
    return view.select("host", "id", *[f"{n}_psec" for n in names])


@FAMILY.add("b8_sample_view", f"WITH {sample_sql(COUNTERS + GAUGES, PARAMS)} SELECT * FROM sv")
def b8(spark, sf):
    return samples_view(ev_samples(spark, sf, COUNTERS + GAUGES + PARAMS), CAT, COUNTERS + GAUGES, PARAMS)


CHANGING = ["max_connections", "table_cache", "thread_cache_size", "sync_binlog", "max_binlog_size",
            "relay_log_space_limit"]


@FAMILY.add(
    "b9_param_change",
    f"WITH {delta_sql([], [], extra=CHANGING)} "
    + " UNION ALL ".join(
        f"SELECT c.host AS host, c.ts AS ts, '{p}' AS variable_name, p.{p} AS old_value, c.{p} AS new_value "
        f"FROM samples c JOIN samples p ON p.host = c.host AND p.id = c.id - 1 WHERE c.{p} <> p.{p}"
        for p in CHANGING
    ),
)
def b9(spark, sf):
    # "timestamp" is a parameter that always changes and is never reported.
    return param_changes(ev_samples(spark, sf, [*CHANGING, "timestamp"]), CAT, block=BLOCK)


@FAMILY.add(
    "b10_params_at_sample",
    f"WITH {delta_sql([], PARAMS)} SELECT host, id, ts, max_connections, table_cache FROM delta",
)
def b10(spark, sf):
    d = delta(ev_samples(spark, sf, PARAMS), CAT, [], PARAMS, block=BLOCK)
    return d.select("host", "id", "ts", *PARAMS)
