"""Rules, events, episodes, views, notifications."""

from pyspark.sql import functions as F

from gaugeweave.catalog import SAMPLE
from gaugeweave.checks.fixtures import AS_OF, CAT, as_of, ev_samples, table
from gaugeweave.checks.oracle import delta_sql, report_sql, samples_sql
from gaugeweave.checks.registry import Family
from gaugeweave.operators.alerts import (
    Condition,
    alert_events,
    alert_view,
    condition_query,
    conditions_frame,
    digest,
    episodes,
    evaluate,
    evaluate_wide,
    mark_notified,
    newest_pending,
    notifications,
    notified_ids,
    pending,
    pending_listing,
    pending_view,
    process_summary,
    resolve,
    rule_inputs_table,
    unresolved,
    upsert_pending,
)
from gaugeweave.operators.delta import delta, latest
from gaugeweave.operators.ingest import purge, purge_orphans
from gaugeweave.operators.report import METRICS, inputs_of
from gaugeweave.operators.rollup import latest_rows
from gaugeweave.plans.charts import report_of
from gaugeweave.session import materialize

FAMILY = Family()
SAMPLE_COLUMNS = ("host", "id", "ts", "ts_diff_seconds")
BLOCK = 128  # small, so that episodes cross block edges on the given tables
NAMES = ["threads_connected", "seconds_behind_master", "com_select_psec", "uptime_percent"]
CONDITIONS = [
    Condition(1, "threads_connected > 25", "", " Many threads ", "warning", 0, False),
    Condition(2, "seconds_behind_master > 10", "", "Replica lags", "critical", 4, True),
    Condition(3, "uptime_percent >= 50", "", "Is up", "info", 30, False),
    Condition(4, "threads_running_never", "", "Switched off", "error", 0, False, enabled=False),
    Condition(5, "threads_connected", "n_samples > 200", "Number as truth", "debug", 10, False),
    Condition(6, "", "cores = 8", "Host rule only", "error", 60, True),
]
FIRES = {
    1: "coalesce(threads_connected > 25, false)",
    2: "coalesce(seconds_behind_master > 10, false)",
    3: "coalesce(uptime_percent >= 50, false)",
    5: "coalesce(threads_connected <> 0, false) AND coalesce(n_samples > 200, false)",
    6: "coalesce(cores = 8, false)",
}


def host_facts(spark, sf):
    return ev_samples(spark, sf, ["os_total_cpu_cores"]).groupBy("host").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max_by("os_total_cpu_cores", "id").alias("cores")
    )


def alert_report(spark, sf):
    needs = inputs_of(NAMES, CAT)
    return report_of(ev_samples(spark, sf, [*needs.metrics, *needs.params]), SAMPLE, NAMES, CAT)


def shared_report(spark, sf):
    """Written once where evaluation and views both read it."""
    return materialize(alert_report(spark, sf), "report")


def fired_wide(spark, sf, rows=None):
    return evaluate_wide(alert_report(spark, sf) if rows is None else rows, CONDITIONS, host_facts(spark, sf))


def fired(spark, sf):
    return evaluate(alert_report(spark, sf), CONDITIONS, host_facts(spark, sf))


FACTS = (
    f"facts AS (SELECT host, count(*) AS n_samples, CAST(arg_max(8 + id % 2, id) AS BIGINT) AS cores FROM samples "
    "GROUP BY host)"
)
FIRED = (
    f"{report_sql(NAMES)}, {FACTS}, fired AS ("
    + " UNION ALL ".join(
        f"SELECT report.host AS host, id, ts, {i} AS alert_condition_id, ({e}) AS fired FROM report JOIN facts USING (host)"
        for i, e in FIRES.items()
    )
    + ")"
)
ISLANDS = (
    f"{FIRED}, walked AS (SELECT *, sum(CASE WHEN fired THEN 0 ELSE 1 END) OVER (PARTITION BY host, alert_condition_id "
    "ORDER BY id) AS quiet FROM fired), runs AS (SELECT host, alert_condition_id, min(id) AS start_id, max(id) AS end_id, "
    "min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS fires FROM walked WHERE fired GROUP BY host, alert_condition_id, quiet)"
)
RULES = "rules(alert_condition_id, condition_eval, monitored_host_condition_eval, description, error_level, delay, " \
    "repetitive_alert) AS (VALUES " + ", ".join(
        f"({c.alert_condition_id}, '{c.condition_eval}', '{c.monitored_host_condition_eval}', '{c.description}', "
        f"'{c.error_level}', {c.alert_delay_minutes}, {c.repetitive_alert})" for c in CONDITIONS) + ")"


@FAMILY.add("h1_evaluate", f"WITH {FIRED} SELECT * FROM fired")
def h1(spark, sf):
    return fired(spark, sf)


@FAMILY.add(
    "h1_evaluate_latest",
    f"WITH {FIRED} SELECT * FROM fired QUALIFY id = max(id) OVER (PARTITION BY host)",
)
def h1_latest(spark, sf):
    return evaluate(latest_rows(alert_report(spark, sf)), CONDITIONS, host_facts(spark, sf))


RULE_TEXTS = (
    "CASE s_suppkey % 6 WHEN 0 THEN concat('threads_connected > ', CAST(s_suppkey AS STRING)) "
    "WHEN 1 THEN 'com_select_psec + Uptime_Percent > least(1, seconds_behind_master)' WHEN 2 THEN 'no_such > 1 OR uptime > 1' "
    "WHEN 3 THEN 'uptime >> (' WHEN 4 THEN '' ELSE 'threads_running > 1 OR threads_running < -1' END"
)
RULE_INPUTS = {0: "threads_connected", 1: "com_select_psec,seconds_behind_master,uptime_percent", 2: "no_such,uptime", 3: "", 4: "",
               5: "threads_running"}


@FAMILY.add(
    "h1_rule_inputs",
    "SELECT CAST(s_suppkey AS INTEGER) AS alert_condition_id, CASE s_suppkey % 6 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in RULE_INPUTS.items())
    + " END AS inputs, s_suppkey % 6 IN (2, 3) AS failed FROM supplier",
)
def h1_inputs(spark, sf):
    """Columns read out of the parsed texts of a rule table; rules with unknown columns or bad syntax are told apart."""
    texts = table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS INT) AS alert_condition_id", f"{RULE_TEXTS} AS condition_eval", "'' AS monitored_host_condition_eval",
        "s_name AS description", "'error' AS error_level", "0 AS alert_delay_minutes", "false AS repetitive_alert", "true AS enabled")
    found = rule_inputs_table(texts, [*METRICS, *SAMPLE_COLUMNS])
    return found.selectExpr("alert_condition_id", "array_join(columns, ',') AS inputs", "error IS NOT NULL AS failed")


@FAMILY.add(
    "h2_host_predicate",
    f"WITH {FIRED} SELECT host, alert_condition_id, count(*) FILTER (WHERE fired) AS fires FROM fired "
    "WHERE alert_condition_id IN (5, 6) GROUP BY host, alert_condition_id",
)
def h2(spark, sf):
    second = [c for c in CONDITIONS if c.monitored_host_condition_eval]
    rows = evaluate(alert_report(spark, sf), second, host_facts(spark, sf))
    return rows.groupBy("host", "alert_condition_id").agg(F.count_if("fired").alias("fires"))


@FAMILY.add(
    "h3_alert_events",
    f"WITH {FIRED} SELECT DISTINCT host, alert_condition_id, id AS sv_report_sample_id FROM fired "
    "WHERE fired AND alert_condition_id > 2",
)
def h3(spark, sf):
    rows = fired(spark, sf)
    stored = alert_events(rows).where("alert_condition_id <= 2")
    return alert_events(rows.union(rows), stored)


@FAMILY.add("h4_episodes", f"WITH {ISLANDS} SELECT * FROM runs")
def h4(spark, sf):
    return episodes(fired_wide(spark, sf), BLOCK)


@FAMILY.add(
    "h4_pending_upsert",
    f"WITH {FIRED}, e AS (SELECT host, alert_condition_id, id FROM fired WHERE fired), "
    "old AS (SELECT host, alert_condition_id, min(id) AS s, max(id) AS t FROM e WHERE id < 500 GROUP BY ALL), "
    "new AS (SELECT host, alert_condition_id, min(id) AS s, max(id) AS t FROM e WHERE id >= 500 GROUP BY ALL) "
    "SELECT host, alert_condition_id, coalesce(old.s, new.s) AS sv_report_sample_id_start, "
    "coalesce(new.t, old.t) AS sv_report_sample_id_end, CAST(NULL AS TIMESTAMP) AS ts_notified, false AS resolved "
    "FROM old FULL JOIN new USING (host, alert_condition_id)",
)
def h4_upsert(spark, sf):
    events = alert_events(fired(spark, sf))
    earlier = events.where("sv_report_sample_id < 500").groupBy("host", "alert_condition_id").agg(
        F.min("sv_report_sample_id").alias("start_id"), F.max("sv_report_sample_id").alias("end_id"))
    return upsert_pending(pending(earlier), events.where("sv_report_sample_id >= 500"))


EVALUATED = "seen AS (SELECT host, max(id) AS id_evaluated FROM report GROUP BY host)"
PENDING = (
    f"{ISLANDS}, {EVALUATED}, pend AS (SELECT host, alert_condition_id, start_id AS sv_report_sample_id_start, "
    "end_id AS sv_report_sample_id_end, CAST(NULL AS TIMESTAMP) AS ts_notified, end_id < id_evaluated AS resolved "
    "FROM runs JOIN seen USING (host))"
)


def evaluated_to(rows):
    return rows.groupBy("host").agg(F.max("id").alias("id_evaluated"))


def all_pending(spark, sf, rows):
    return resolve(pending(episodes(fired_wide(spark, sf, rows), BLOCK)), evaluated_to(rows))


@FAMILY.add("h5_resolve", f"WITH {PENDING} SELECT * FROM pend")
def h5(spark, sf):
    return all_pending(spark, sf, shared_report(spark, sf))


@FAMILY.add("h6_remove_resolved", f"WITH {PENDING} SELECT * FROM pend WHERE NOT resolved")
def h6(spark, sf):
    return unresolved(all_pending(spark, sf, shared_report(spark, sf)))


@FAMILY.add(
    "h7_alert_view",
    f"WITH {FIRED}, {RULES} SELECT host, alert_condition_id, id AS sv_report_sample_id, trim(condition_eval) AS "
    "condition_eval, trim(monitored_host_condition_eval) AS monitored_host_condition_eval, trim(description) AS "
    "description, error_level, ts FROM fired JOIN rules USING (alert_condition_id) WHERE fired",
)
def h7(spark, sf):
    rows = shared_report(spark, sf)
    events = alert_events(evaluate(rows, CONDITIONS, host_facts(spark, sf)))
    return alert_view(events, conditions_frame(spark, CONDITIONS), rows)


# Two rules count as already notified at a fixed time.
TOLD = "alert_condition_id IN (1, 2)"
VIEW = (
    f"{PENDING}, {RULES}, view AS (SELECT pend.host AS host, alert_condition_id, sv_report_sample_id_start, "
    "trim(condition_eval) AS condition_eval, trim(monitored_host_condition_eval) AS monitored_host_condition_eval, "
    "trim(description) AS description, error_level, CAST(delay AS INTEGER) AS alert_delay_minutes, s.ts AS ts_start, "
    "e.ts AS ts_end, (date_sub('second', s.ts, e.ts) + 3) // 60 AS elapsed_minutes, "
    "(date_sub('second', s.ts, e.ts) + 3) // 60 >= delay AS in_error, "
    f"{TOLD} AS is_notified, CASE WHEN {TOLD} THEN TIMESTAMP '{AS_OF}' END AS ts_notified, resolved, repetitive_alert "
    "FROM pend JOIN rules USING (alert_condition_id) "
    "JOIN report s ON s.host = pend.host AND s.id = sv_report_sample_id_start "
    "JOIN report e ON e.host = pend.host AND e.id = sv_report_sample_id_end)"
)
NEWEST = (
    "newest AS (SELECT * FROM view QUALIFY row_number() OVER (PARTITION BY host, alert_condition_id "
    "ORDER BY sv_report_sample_id_start DESC) = 1)"
)


def viewed(spark, rows, report):
    told = mark_notified(rows, rows.where(TOLD), as_of())
    return pending_view(told, conditions_frame(spark, CONDITIONS), report)


def all_viewed(spark, sf):
    report = shared_report(spark, sf)
    return viewed(spark, materialize(all_pending(spark, sf, report), "pending"), report)


def newest_view(spark, sf):
    report = shared_report(spark, sf)
    rows = resolve(newest_pending(episodes(fired_wide(spark, sf, report), BLOCK)), evaluated_to(report))
    return viewed(spark, materialize(rows, "pending"), report)


@FAMILY.add("h8_pending_view", f"WITH {VIEW} SELECT * FROM view")
def h8(spark, sf):
    return all_viewed(spark, sf)


MESSAGE = (
    "CASE WHEN resolved THEN 'Resolved: ' || description ELSE upper(error_level) || ': ' || description || chr(10) || "
    "'    This ' || error_level || ' alert is pending for ' || elapsed_minutes || ' minutes, since ' || "
    "strftime(ts_start, '%Y-%m-%d %H:%M:%S') END || chr(10) || '    alert_condition id: ' || alert_condition_id || "
    "' [pending id: ' || sv_report_sample_id_start || ']'"
)
DUE = "in_error AND (NOT is_notified OR repetitive_alert OR resolved)"


@FAMILY.add("h9_notifications", f"WITH {VIEW} SELECT *, {MESSAGE} AS message_item FROM view WHERE {DUE}")
def h9(spark, sf):
    return notifications(all_viewed(spark, sf))


RANK = (
    "in_error DESC, list_position(['debug', 'info', 'warning', 'error', 'critical'], error_level) DESC, "
    "elapsed_minutes DESC, alert_condition_id"
)


@FAMILY.add(
    "h10_digest",
    f"WITH {VIEW}, {NEWEST}, items AS (SELECT *, {MESSAGE} AS m FROM newest WHERE {DUE}) SELECT host, concat_ws("
    f"chr(10) || chr(10), string_agg(m, chr(10) || chr(10) ORDER BY {RANK}) FILTER (WHERE NOT resolved), '-------' || "
    f"chr(10) || chr(10) || string_agg(m, chr(10) || chr(10) ORDER BY {RANK}) FILTER (WHERE resolved)) AS digest "
    "FROM items GROUP BY host",
)
def h10(spark, sf):
    return digest(notifications(newest_view(spark, sf)))


@FAMILY.add(
    "h11_mark_notified",
    f"WITH {VIEW}, {NEWEST} SELECT host, alert_condition_id, sv_report_sample_id_start, "
    f"CASE WHEN {DUE} THEN TIMESTAMP '{AS_OF}' ELSE ts_notified END AS ts_notified FROM newest",
)
def h11(spark, sf):
    view = materialize(newest_view(spark, sf), "view")
    marked = mark_notified(view, notified_ids(notifications(view)), as_of())
    return marked.select("host", "alert_condition_id", "sv_report_sample_id_start", "ts_notified")


@FAMILY.add(
    "h12_pending_listing",
    f"WITH {VIEW}, {NEWEST}, open AS (SELECT * FROM newest WHERE NOT resolved AND alert_condition_id <> 6), "
    "hosts AS (SELECT DISTINCT host FROM samples) "
    "SELECT hosts.host AS host, CASE WHEN open.host IS NULL THEN 'ok' WHEN ts_notified IS NULL THEN 'awaiting' "
    "ELSE error_level END AS state, CASE WHEN open.host IS NULL THEN 'OK' WHEN ts_notified IS NULL THEN 'awaiting: ' || "
    "error_level ELSE error_level END AS level_text, coalesce(description, 'No pending alerts') AS description, ts_start, "
    "elapsed_minutes, coalesce(strftime(ts_notified, '%Y-%m-%d %H:%M:%S'), 'ETA: ' || strftime(ts_start + "
    "to_minutes(alert_delay_minutes), '%Y-%m-%d %H:%M:%S')) AS notified_text, CASE WHEN repetitive_alert THEN 'Yes' "
    "WHEN open.host IS NULL THEN NULL ELSE '-' END AS repeating FROM hosts LEFT JOIN open ON open.host = hosts.host",
)
def h12(spark, sf):
    # Without the rule that always fires, some hosts have nothing pending.
    return pending_listing(newest_view(spark, sf).where("alert_condition_id <> 6"), ev_samples(spark, sf, []))


RULE_COLUMNS = (
    "concat('n', CAST(s_nationkey AS STRING)) AS host",
    "CAST(s_suppkey AS INT) AS alert_condition_id",
    "concat('threads_connected > ', CAST(s_suppkey AS STRING)) AS condition_eval",
    "s_suppkey % 4 <> 0 AS enabled",
)


@FAMILY.add(
    "h13_condition_query",
    f"WITH r AS (SELECT {', '.join(RULE_COLUMNS)} FROM supplier) SELECT host, 'SELECT ' || string_agg(condition_eval || "
    "' AS condition_' || alert_condition_id, ' ,' ORDER BY alert_condition_id) || "
    "' FROM sv_report_sample ORDER BY id DESC LIMIT 1;' AS query FROM r WHERE enabled GROUP BY host",
)
def h13(spark, sf):
    return condition_query(table(spark, sf, "supplier").selectExpr(*RULE_COLUMNS))


# Events of one user and minute as one collected process list.
PROCESS = (
    "concat('u', CAST(user_id % 4 AS STRING)) AS host",
    "event_id AS id",
    "concat('user', CAST(user_id AS STRING)) AS \"user\"",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id % 200 AS STRING)) END AS host_from",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'shop' END AS db",
    "CASE WHEN event_type IN ('view', 'click') THEN 'Sleep' ELSE 'Query' END AS command",
    "CAST(floor(value) AS INT) AS time_s",
    "event_type AS state",
    "props AS info",
)


def _line(label, column):
    return f"'{label}' || coalesce(CAST({column} AS VARCHAR), 'NULL')"


@FAMILY.add(
    "h14_process_summary",
    f"WITH p AS (SELECT date_trunc('minute', ts) AS ts, {', '.join(PROCESS)} FROM events), t AS (SELECT *, chr(10) || "
    + " || chr(10) || ".join(
        _line(label, c) for label, c in (
            ("     Id: ", "id"), ("   User: ", '"user"'), ("   Host: ", "host_from"), ("     db: ", "db"),
            ("Command: ", "command"), ("   Time: ", "time_s"), ("  State: ", "state"), ("   Info: ", "info")))
    + " || chr(10) || '-------' AS block FROM p) SELECT host, ts, count(*) FILTER (WHERE command = 'Sleep') AS sleeping, "
    "concat_ws(chr(10), string_agg(block, chr(10) ORDER BY time_s DESC, id) FILTER (WHERE command <> 'Sleep'), "
    "'Sleeping: ' || count(*) FILTER (WHERE command = 'Sleep') || ' processes') AS summary FROM t GROUP BY host, ts",
)
def h14(spark, sf):
    columns = [c.replace('"user"', "`user`") for c in PROCESS]
    rows = table(spark, sf, "events").selectExpr("CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS ts", *columns)
    return process_summary(rows)


@FAMILY.add(
    "h15_evaluated_versus_latest",
    f"WITH {delta_sql([])} SELECT s.host AS host, max(s.id) AS id_latest, (SELECT max(d.id) FROM delta d "
    "WHERE d.host = s.host) AS id_evaluated FROM samples s GROUP BY s.host",
)
def h15(spark, sf):
    samples = ev_samples(spark, sf, [])
    seen = delta(samples, CAT, [], []).groupBy("host").agg(F.max("id").alias("id_evaluated"))
    return latest(samples).drop("ts_latest").join(seen, "host", "left")


@FAMILY.add(
    "a12_retention_purge",
    f"WITH {samples_sql(['com_select'])} SELECT * FROM samples WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY",
)
def a12(spark, sf):
    return purge(ev_samples(spark, sf, ["com_select"]), 14, as_of=as_of())


@FAMILY.add(
    "a13_orphan_purge",
    f"WITH {FIRED}, kept AS (SELECT host, min(id) AS first FROM samples WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY "
    "GROUP BY host) SELECT DISTINCT fired.host AS host, alert_condition_id, id AS sv_report_sample_id FROM fired "
    "LEFT JOIN kept USING (host) WHERE fired AND (first IS NULL OR id >= first)",
)
def a13(spark, sf):
    kept = purge(ev_samples(spark, sf, []), 14, as_of=as_of())
    return purge_orphans(alert_events(fired(spark, sf)), kept)
