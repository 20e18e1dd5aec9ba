"""Streams over the given tables, drained and read back."""

from functools import reduce

from pyspark.sql import functions as F

from gaugeweave.catalog import DAY, HOUR
from gaugeweave.checks.alert_queries import BLOCK, CONDITIONS, ISLANDS, NAMES, host_facts
from gaugeweave.checks.fixtures import CAT, COLUMNS, HOST, ev_samples, table
from gaugeweave.checks.oracle import delta_sql, rollup_select, sample_sql, samples_sql
from gaugeweave.checks.registry import Family
from gaugeweave.checks.rollup_queries import AVERAGED, DIGITS, TEN_MINUTES, sample_report
from gaugeweave.functions.numeric import rate_text
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.alerts import evaluate_wide
from gaugeweave.operators.delta import rates
from gaugeweave.operators.report import inputs_of, report
from gaugeweave.operators.states import averages
from gaugeweave.session import materialize, scratch_dir
from gaugeweave.plans.collection import CollectionRun
from gaugeweave.sources.tables import read_table
from gaugeweave.streaming.alerts import EpisodeStep
from gaugeweave.streaming.deltas import DeltaStep, TableDeltaStep
from gaugeweave.streaming.keyed import keyed_deltas, keyed_state, silent_hosts
from gaugeweave.streaming.ingest import SilenceStep, unique_seconds
from gaugeweave.streaming.late import WindowStep, average_parts, rollup_parts
from gaugeweave.streaming.repair import RepairStep
from gaugeweave.streaming.rollups import RefreshStep, closed_windows
from gaugeweave.streaming.run import each_batch, output_table, read_files, state_table, to_table

FAMILY = Family()
RUN_COLUMNS = sorted({*inputs_of(NAMES, CAT).metrics, *inputs_of(NAMES, CAT).params, "com_select", "uptime"})
METRICS = ["com_select", "uptime", "threads_connected"]
PARAMS = ["max_connections"]
BATCHES = 3


def event_stream(spark, sf, columns=()):
    """The events file as a stream of samples."""
    schema = table(spark, sf, "events").schema
    events = read_files(spark, sf, schema, pattern="events.parquet")
    picked = [f"CAST({COLUMNS[c]} AS BIGINT) AS `{c}`" for c in columns]
    return events.selectExpr(f"{HOST} AS host", "event_id AS id", "ts", *picked)


def arrivals(spark, rows, part, batches):
    """The rows of each part as files that arrive together, one micro-batch. All tasks write them, and all can read them."""
    path, files = scratch_dir(spark, "arrivals"), spark.sparkContext.defaultParallelism
    for i in range(batches):
        folder = f"{path}/{i}"
        rows.where(part == i).repartition(files, "id").write.parquet(folder)
        # A batch is a number of files: files without rows stand for tasks that had none.
        for _ in range(files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return read_files(spark, f"{path}/*", rows.schema, files_per_batch=files)


def staged(spark, rows):
    """All rows in order of their number."""
    rows = materialize(rows, "arriving")
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    return arrivals(spark, rows, F.least(F.floor((F.col("id") - low) * BATCHES / (high - low + 1)), F.lit(BATCHES - 1)), BATCHES)


def dealt(spark, rows, batches=BATCHES):
    """All rows by hash: neighbours fall into different batches, in no order of number or time."""
    return arrivals(spark, materialize(rows, "arriving"), F.pmod(F.xxhash64("id"), F.lit(batches)), batches)


@FAMILY.add(
    "j1_stream_ingest",
    f"WITH {samples_sql([])} SELECT host, ts FROM samples",
)
def j1(spark, sf):
    path = scratch_dir(spark, "ingested")
    to_table(unique_seconds(event_stream(spark, sf)), path, scratch_dir(spark, "state"))
    return spark.read.parquet(path).select("host", F.col("ts").cast(NTZ).alias("ts"))


@FAMILY.add("j2_stream_delta", f"WITH {delta_sql(METRICS, PARAMS)} SELECT * FROM delta")
def j2(spark, sf):
    out, carried = output_table(spark, "deltas"), state_table(spark, "carried")
    step = DeltaStep(CAT, METRICS, PARAMS, carried)
    stream = staged(spark, ev_samples(spark, sf, [*METRICS, *PARAMS]))
    each_batch(stream, lambda batch, n: out.write(step(batch, n), n) and None, scratch_dir(spark, "state"))
    return out.all(spark)


@FAMILY.add("j2_stream_delta_out_of_order", f"WITH {delta_sql(METRICS, PARAMS)} SELECT * FROM delta")
def j2_any_order(spark, sf):
    out = output_table(spark, "deltas")
    step = TableDeltaStep(CAT, METRICS, PARAMS, scratch_dir(spark, "samples"), state_table(spark, "noted"), shards=1)
    stream = dealt(spark, ev_samples(spark, sf, [*METRICS, *PARAMS]))
    each_batch(stream, lambda batch, n: out.write(step(batch, n), n) and None, scratch_dir(spark, "state"))
    return out.all(spark)


# Hours whose end the watermark (newest delta minus ten minutes) has passed.
CLOSED = "SELECT * FROM rolled WHERE end_ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM delta)"


@FAMILY.add(
    "j3_stream_hours",
    f"WITH {delta_sql(METRICS)}, rolled AS ({rollup_select('hour', METRICS)}) {CLOSED}",
)
def j3(spark, sf):
    from gaugeweave.operators.delta import delta

    source, path = scratch_dir(spark, "deltas"), scratch_dir(spark, "hours")
    rows = delta(ev_samples(spark, sf, METRICS), CAT, METRICS, [])
    rows.write.parquet(source)
    stream = read_files(spark, source, rows.schema)
    to_table(closed_windows(stream, HOUR, METRICS), path, scratch_dir(spark, "state"))
    return spark.read.parquet(path)


def windowed(spark, rows, parts):
    """All windows of rows that are dealt to micro-batches by hash, so that most come behind the clock."""
    step = WindowStep(parts, state_table(spark, "clock"), state_table(spark, "opened"), output_table(spark, "closed"),
                      output_table(spark, "late"))
    each_batch(dealt(spark, rows), step, scratch_dir(spark, "state"))
    return step.every(spark)


def _register_late(key, grain):
    @FAMILY.add(key, f"WITH {delta_sql(METRICS, PARAMS)} {rollup_select(grain.name, METRICS, PARAMS, rate_mode='ratio')}")
    def query(spark, sf):
        from gaugeweave.operators.delta import delta

        rows = delta(ev_samples(spark, sf, [*METRICS, *PARAMS]), CAT, METRICS, PARAMS)
        windows = windowed(spark, rows, rollup_parts(grain, METRICS, PARAMS))
        return windows.withColumns({f"{m}_psec": F.expr(rate_text(f"{m}_diff", "ts_diff_seconds")) for m in METRICS})


_register_late("j3_late_rows_hour", HOUR)
_register_late("j3_late_rows_day", DAY)


@FAMILY.add("j3_late_rows_ten_minutes", TEN_MINUTES)
def j3_late_averages(spark, sf):
    return averages(windowed(spark, sample_report(spark, sf, AVERAGED), average_parts(DIGITS)), DIGITS)


@FAMILY.add("j4_stream_refresh", f"WITH {delta_sql(METRICS, PARAMS)} {rollup_select('hour', METRICS, PARAMS)}")
def j4(spark, sf):
    samples, rolled = scratch_dir(spark, "samples"), scratch_dir(spark, "rolled")
    step = RefreshStep(CAT, METRICS, PARAMS, samples, {HOUR: rolled}, shards=1)
    rows = ev_samples(spark, sf, [*METRICS, *PARAMS])
    # Odd hours first: the even ones then come late and sit between stored samples.
    stream = arrivals(spark, materialize(rows, "arriving"), (F.hour("ts") + 1) % 2, 2)
    each_batch(stream, step, scratch_dir(spark, "state"))
    return read_table(spark, rolled)


STEP = "auto_increment_increment"
STEP_BACK = f"greatest(1, coalesce(c.{STEP}, 1))"


@FAMILY.add(
    "j4_refresh_step_column",
    f"WITH {delta_sql(METRICS, PARAMS, STEP_BACK, [STEP])} {rollup_select('hour', METRICS, PARAMS)}",
)
def j4_step(spark, sf):
    """Numbering steps that differ from row to row, rows dealt by hash."""
    samples, rolled = scratch_dir(spark, "samples"), scratch_dir(spark, "rolled")
    step = RefreshStep(CAT, METRICS, PARAMS, samples, {HOUR: rolled}, shards=1, step=STEP)
    each_batch(dealt(spark, ev_samples(spark, sf, [*METRICS, *PARAMS, STEP])), step, scratch_dir(spark, "state"))
    return read_table(spark, rolled)


@FAMILY.add(
    "j2_stream_delta_step_column",
    f"WITH {delta_sql(METRICS, PARAMS, STEP_BACK, [STEP])} SELECT * FROM delta",
)
def j2_step(spark, sf):
    out = output_table(spark, "deltas")
    step = TableDeltaStep(CAT, METRICS, PARAMS, scratch_dir(spark, "samples"), state_table(spark, "noted"), shards=1, step=STEP)
    stream = dealt(spark, ev_samples(spark, sf, [*METRICS, *PARAMS, STEP]))
    each_batch(stream, lambda batch, n: out.write(step(batch, n), n) and None, scratch_dir(spark, "state"))
    return out.all(spark)


@FAMILY.add("j2_keyed_state_delta", f"WITH {sample_sql(METRICS, PARAMS)} SELECT * FROM sv")
def j2_keyed(spark, sf):
    path = scratch_dir(spark, "keyed")
    stream = staged(spark, ev_samples(spark, sf, [*METRICS, *PARAMS]))
    with keyed_state(spark, idle_batches=False):
        to_table(rates(keyed_deltas(stream, CAT, METRICS, PARAMS, block=256), METRICS), path, scratch_dir(spark, "state"))
    return spark.read.parquet(path)


@FAMILY.add("j5_stream_episodes", f"WITH {ISLANDS} SELECT * FROM runs")
def j5(spark, sf):
    needs = inputs_of(NAMES, CAT)
    ended = output_table(spark, "ended")
    state, carried = state_table(spark, "open"), state_table(spark, "carried")
    changes = DeltaStep(CAT, needs.metrics, needs.params, carried)
    episodes = EpisodeStep(state, ended, BLOCK)
    facts = host_facts(spark, sf)
    last = []

    def step(batch, number):
        rows = report(rates(changes(batch, number), needs.rates), NAMES, CAT)
        episodes(evaluate_wide(rows, CONDITIONS, facts), number)
        last.append(number)

    each_batch(staged(spark, ev_samples(spark, sf, [*needs.metrics, *needs.params])), step, scratch_dir(spark, "state"))
    return ended.all(spark).unionByName(episodes.still_open(spark, max(last)).drop("ts_notified"))


TOLD_DELAYS = "VALUES " + ", ".join(f"({c.alert_condition_id}, {c.alert_delay_minutes})" for c in CONDITIONS)


@FAMILY.add(
    "j5_stream_episodes_out_of_order",
    f"WITH {ISLANDS}, delays(alert_condition_id, delay) AS ({TOLD_DELAYS}), newest AS (SELECT host, max(id) AS last_id FROM "
    "fired GROUP BY host), judged AS (SELECT runs.*, end_id < last_id AS closed, (date_sub('second', ts_start, ts_end) + 3) // 60 "
    ">= delay AS in_error FROM runs JOIN delays USING (alert_condition_id) JOIN newest USING (host)) "
    "SELECT host, alert_condition_id, start_id, end_id, ts_start, ts_end, fires, closed, "
    "CAST(CASE WHEN NOT in_error THEN 0 WHEN closed THEN 2 ELSE 1 END AS BIGINT) AS notices FROM judged",
)
def j5_any_order(spark, sf):
    """Rows dealt by hash, so that neighbours come in different batches; episodes beside what was told and still stands."""
    needs = inputs_of(NAMES, CAT)
    columns = [*needs.metrics, *needs.params]
    changes = TableDeltaStep(CAT, needs.metrics, needs.params, scratch_dir(spark, "samples"), state_table(spark, "noted"), shards=1)
    repair = RepairStep(scratch_dir(spark, "evaluated"), scratch_dir(spark, "runs"), CONDITIONS, output_table(spark, "notices"), BLOCK, shards=1)
    facts = host_facts(spark, sf)

    def step(batch, number):
        rows = report(rates(changes(batch, number), needs.rates), NAMES, CAT)
        repair(evaluate_wide(rows, CONDITIONS, facts), number)

    each_batch(dealt(spark, ev_samples(spark, sf, columns)), step, scratch_dir(spark, "state"))
    standing = repair.standing_notices(spark).groupBy("host", "alert_condition_id", "start_id").agg(F.sum("times").alias("notices"))
    joined = repair.episodes(spark).join(standing, ["host", "alert_condition_id", "start_id"], "full")
    return joined.withColumn("notices", F.coalesce("notices", F.lit(0)))


@FAMILY.add(
    "j6_silent_hosts",
    f"WITH {samples_sql([])}, newest AS (SELECT host, max(ts) AS ts_last FROM ev GROUP BY host) SELECT host, ts_last "
    "FROM newest WHERE ts_last + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)",
)
def j6(spark, sf):
    silent = output_table(spark, "silent")
    step = SilenceStep(state_table(spark, "seen"), silent)
    each_batch(event_stream(spark, sf), step, scratch_dir(spark, "state"))
    return silent.all(spark)


@FAMILY.add(
    "j6_silent_hosts_by_timer",
    f"WITH {samples_sql([])}, newest AS (SELECT host, max(date_trunc('second', ts)) AS ts_last FROM ev GROUP BY host) SELECT host, "
    "ts_last FROM newest WHERE ts_last + INTERVAL 1 HOUR <= (SELECT max(date_trunc('second', ts)) - INTERVAL 10 MINUTE FROM ev)",
)
def j6_timer(spark, sf):
    path = scratch_dir(spark, "silent")
    seconds = event_stream(spark, sf).withColumn("ts", F.date_trunc("SECOND", "ts"))
    with keyed_state(spark):
        to_table(silent_hosts(seconds), path, scratch_dir(spark, "state"))
    return spark.read.parquet(path)


@FAMILY.add(
    "j7_collection_run",
    f"WITH {ISLANDS}, rolled AS ({rollup_select('hour', ['com_select', 'uptime'], source='delta')}), "
    f"delays(alert_condition_id, delay) AS ({TOLD_DELAYS}), newest AS (SELECT host, max(id) AS last_id FROM fired GROUP BY host), "
    "told AS (SELECT host, CASE WHEN (date_sub('second', ts_start, ts_end) + 3) // 60 < delay THEN 0 WHEN end_id < last_id THEN 2 "
    "ELSE 1 END AS n FROM runs JOIN delays USING (alert_condition_id) JOIN newest USING (host)) "
    "SELECT host, 'samples' AS what, count(*) AS n FROM samples GROUP BY host "
    "UNION ALL SELECT host, 'hours', count(*) FROM rolled GROUP BY host "
    "UNION ALL SELECT host, 'hour changes', CAST(sum(com_select_diff + uptime_diff) AS BIGINT) FROM rolled GROUP BY host "
    "UNION ALL SELECT host, 'alerts', count(*) FROM fired WHERE fired GROUP BY host "
    "UNION ALL SELECT host, 'episodes', count(*) FROM runs GROUP BY host "
    "UNION ALL SELECT host, 'notices', CAST(sum(n) AS BIGINT) FROM told GROUP BY host HAVING sum(n) > 0",
)
def j7(spark, sf):
    """The whole run over rows dealt by hash; what it leaves, counted."""
    job = CollectionRun(scratch_dir(spark, "run"), CAT, ["com_select", "uptime"], [], CONDITIONS, host_facts(spark, sf), block=BLOCK, shards=1)
    job.run(dealt(spark, ev_samples(spark, sf, RUN_COLUMNS), 2))
    hours = job.table(spark, "hour")

    def counted(rows, what, n=F.count(F.lit(1))):
        return rows.groupBy("host").agg(n.alias("n")).select("host", F.lit(what).alias("what"), "n")

    parts = [counted(job.table(spark, "samples"), "samples"), counted(hours, "hours"),
             counted(hours, "hour changes", F.sum(F.col("com_select_diff") + F.col("uptime_diff"))),
             counted(job.table(spark, "alerts"), "alerts"), counted(job.repair.episodes(spark), "episodes"),
             counted(job.repair.standing_notices(spark), "notices", F.sum("times"))]
    return reduce(lambda a, b: a.unionByName(b), parts)
