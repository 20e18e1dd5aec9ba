from pyspark.sql import functions as F

from gaugeweave.catalog import CHARTS, DAY, HOUR, SAMPLE, MetricCatalog
from gaugeweave.checks.fixtures import CAT, as_of, ev_samples
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.alerts import Condition, episodes, evaluate_wide, pending_view, notifications, pending, resolve
from gaugeweave.operators.alerts import alert_events, conditions_frame, fired_long
from gaugeweave.operators.custom import CustomQuery
from gaugeweave.operators.delta import delta, delta_since
from gaugeweave.operators.report import inputs_of
from gaugeweave.operators.rollup import rollup
from gaugeweave.plans.charts import chart_payloads, names_of, report_of, report_of_rollup
from gaugeweave.plans.checkpoint import Checkpoint
from gaugeweave.plans.collection import CollectionRun
from gaugeweave.session import scratch_dir
from gaugeweave.sources.tables import append_rows, read_table
from conftest import rows_of

SF = "/root/testdata/sf0.001"
DRAWN = [c for c in CHARTS if c.alias in ("uptime_percent", "connections_usage")]


def moment(text):
    return F.lit(text).cast(NTZ)


def test_delta_since_equals_filtered_delta(spark):
    samples = ev_samples(spark, SF, ["com_select", "max_connections"])
    for since, lookback in (("2024-01-15 00:00:00", 1), ("2024-01-20 07:00:00", 1), ("2024-01-02 00:00:00", 30)):
        got = delta_since(samples, CAT, moment(since), ["com_select"], ["max_connections"], lookback)
        want = delta(samples, CAT, ["com_select"], ["max_connections"]).where(F.col("ts") >= moment(since))
        assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_delta_since_finds_old_predecessors(make):
    rows = [("a", 1, 0, 5), ("a", 2, 60, 6), ("b", 1, 0, 1), ("b", 2, 86400 * 5, 9), ("b", 3, 86400 * 5 + 60, 11)]
    got = delta_since(make(rows, "com_select"), CAT, moment("2024-01-05 00:00:00"), ["com_select"])
    assert rows_of(got, "host", "id", "com_select_diff") == [("b", 2, 8), ("b", 3, 2)]


def test_time_filter_skips_folders(spark):
    path = scratch_dir(spark, "samples")
    append_rows(ev_samples(spark, SF, ["com_select"]), path, shards=1)
    stored = spark.read.parquet(path)
    plan = stored.where(F.col("day") >= F.to_date(F.lit("2024-01-29"))).select("id")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "day" in text.split("PartitionFilters:")[1].split("]")[0]


def test_charts_of_pruned_and_whole_scans_agree(spark):
    needs = inputs_of(names_of(DRAWN), CAT)
    samples = ev_samples(spark, SF, [*needs.metrics, *needs.params])
    for grain in (SAMPLE, HOUR):
        pruned = chart_payloads(samples, grain, as_of(), CAT, DRAWN)
        # A step column takes the unpruned way.
        stepped = samples.withColumn("one", F.lit(1))
        whole = chart_payloads(stepped, grain, as_of(), CAT, DRAWN, step="one")
        assert rows_of(pruned, "host", "alias", "payload") == rows_of(whole, "host", "alias", "payload")


def test_report_of_stored_rollup(spark):
    names = ["com_select_psec", "uptime_percent"]
    needs = inputs_of(names, CAT)
    samples = ev_samples(spark, SF, needs.metrics)
    rolled = rollup(delta(samples, CAT, needs.metrics, []), DAY, needs.metrics)
    assert rows_of(report_of_rollup(rolled, names, CAT), "host", "ts", *names) == rows_of(
        report_of(samples, DAY, names, CAT), "host", "ts", *names)


RULES = [Condition(1, "threads_connected > 25", description="Many threads", error_level="warning"),
         Condition(2, "uptime_percent >= 50", description="Up", alert_delay_minutes=30)]


def test_collection_run(spark):
    """Batches through the whole run leave what one pass over everything computes."""
    watched = ["threads_connected", "uptime_percent"]
    needs = inputs_of(watched, CAT)
    samples = ev_samples(spark, SF, needs.metrics).where("host IN ('h0', 'h4')").cache()
    job = Checkpoint(scratch_dir(spark, "run"), CAT, needs.metrics, [], watched, RULES, shards=1)
    for n, (low, high) in enumerate(((0, 300), (300, 650), (650, 1000))):
        job(samples.where(f"id >= {low} AND id < {high}"), n)
    deltas = delta(samples, CAT, needs.metrics, [])
    assert job.samples(spark).count() == samples.count()
    for grain, table in ((HOUR, job.hours(spark)), (DAY, job.days(spark))):
        want = rollup(deltas, grain, needs.metrics)
        assert rows_of(table, "host", "ts", "uptime_diff") == rows_of(want, "host", "ts", "uptime_diff")
    runs = episodes(evaluate_wide(report_of(samples, SAMPLE, watched, CAT), RULES))
    got = read_table(spark, job.path("resolved")).select("host", "alert_condition_id", "start_id", "end_id")
    kept = set(rows_of(got, *got.columns))
    last = {r.host: r.m for r in deltas.groupBy("host").agg(F.max("id").alias("m")).collect()}
    assert kept == {r for r in rows_of(runs, *got.columns) if r[3] < last[r[0]]}
    # Every resolved episode whose delay had passed was told.
    report = report_of(samples, SAMPLE, watched, CAT)
    seen = spark.createDataFrame(list(last.items()), "host string, id_evaluated long")
    view = pending_view(resolve(pending(runs), seen), conditions_frame(spark, RULES), report)
    due = rows_of(notifications(view), "host", "alert_condition_id", "sv_report_sample_id_start", "resolved")
    sent = rows_of(job.notices(spark), "host", "alert_condition_id", "sv_report_sample_id_start", "resolved")
    assert set(due) <= set(sent)


def test_collection_run_in_any_order(spark):
    """Batches dealt at random, with a slow and a failing custom query."""
    samples = ev_samples(spark, SF, ["threads_connected", "uptime"]).where("host IN ('h0', 'h4')").cache()
    custom = [CustomQuery(1, "SELECT 41 + 1"), CustomQuery(2, "SELECT nosuch"), CustomQuery(3, "SELECT count(*) FROM range(100000000000) WHERE sha2(string(id), 512) > 'x'")]
    cat = MetricCatalog(custom_ids=(1, 2, 3))
    rules = [*RULES, Condition(3, "no_such_metric > 1"), Condition(4, "x >> (")]
    job = CollectionRun(scratch_dir(spark, "run"), cat, ["uptime"], [], rules, custom=custom, custom_seconds=2.0, block=64, shards=1)
    parts = [samples.where(f"pmod(hash(id), 2) = {i}") for i in (0, 1)]
    job(parts[0], 0)
    job(parts[1], 1)
    stored = job.table(spark, "samples")
    assert stored.count() == samples.count()
    filled = stored.where("custom_1 IS NOT NULL")
    assert {r["custom_1"] for r in filled.collect()} == {42} and 2 <= filled.count() <= 4
    assert stored.where("custom_2 IS NOT NULL OR custom_3 IS NOT NULL OR custom_3_time IS NOT NULL").isEmpty()
    wide = evaluate_wide(report_of(samples, SAMPLE, ["threads_connected", "uptime_percent"], CAT), RULES)
    columns = ("host", "alert_condition_id", "start_id", "end_id", "fires")
    assert rows_of(job.repair.episodes(spark), *columns) == rows_of(episodes(wide), *columns)
    keys = ("host", "alert_condition_id", "sv_report_sample_id")
    assert rows_of(job.table(spark, "alerts"), *keys) == rows_of(alert_events(fired_long(wide)), *keys)
    runs = episodes(wide)
    last = deltas_last(samples)
    seen = spark.createDataFrame(list(last.items()), "host string, id_evaluated long")
    view = pending_view(resolve(pending(runs), seen), conditions_frame(spark, RULES), report_of(samples, SAMPLE, ["uptime_percent"], CAT))
    due = view.where("in_error").select("host", "alert_condition_id", F.col("sv_report_sample_id_start").alias("start_id"), "resolved")
    told = due.where("resolved").union(due.withColumn("resolved", F.lit(False)))
    standing = job.repair.standing_notices(spark)
    assert rows_of(standing, "host", "alert_condition_id", "start_id", "resolved") == rows_of(told, "host", "alert_condition_id", "start_id", "resolved")
    assert {r["times"] for r in standing.collect()} == {1}


def deltas_last(samples):
    return {r.host: r.m for r in delta(samples, CAT, ["uptime"], []).groupBy("host").agg(F.max("id").alias("m")).collect()}


def test_collection_run_purges_old_days(spark, make):
    job = CollectionRun(scratch_dir(spark, "run"), MetricCatalog(), ["uptime"], [], [Condition(1, "uptime_percent >= 0")], keep_days=2, shards=1)
    day = 86_400
    job(make([("a", i, i * day // 2, i * 100) for i in range(8)], "uptime"), 0)
    assert [r["d"] for r in job.table(spark, "samples").selectExpr("CAST(to_date(ts) AS STRING) AS d").distinct().orderBy("d").collect()] == [
        "2024-01-02", "2024-01-03", "2024-01-04"]
    job(make([("a", 8, 4 * day, 900)], "uptime"), 1)
    assert job.table(spark, "samples").where("ts < DATE '2024-01-03'").isEmpty()
    assert job.table(spark, "alerts").where("ts < DATE '2024-01-03'").isEmpty() and not job.table(spark, "alerts").isEmpty()
