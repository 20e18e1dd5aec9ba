import random

from pyspark.sql import functions as F

from gaugeweave.operators.alerts import (
    Condition,
    conditions_frame,
    digest,
    episodes,
    evaluate,
    mark_notified,
    notifications,
    pending,
    pending_order,
    pending_view,
    resolve,
)
from gaugeweave.streaming.alerts import EpisodeStep
from gaugeweave.streaming.run import output_table, state_table
from conftest import rows_of


def brute_force(rows, rules):
    found = []
    for host in sorted({r[0] for r in rows}):
        for c in rules:
            run = None
            for _, i, *fired in sorted(r for r in rows if r[0] == host):
                if fired[c - 1]:
                    run = [run[0], i, run[2] + 1] if run else [i, i, 1]
                elif run:
                    found.append((host, c, *run))
                    run = None
            if run:
                found.append((host, c, *run))
    return sorted(found)


COLUMNS = ("host", "alert_condition_id", "start_id", "end_id", "fires")


def random_rows(seed):
    rng = random.Random(seed)
    rows, ids = [], {h: sorted(rng.sample(range(600), 300)) for h in "ab"}
    for h, numbers in ids.items():
        state = [False, True, False]
        for i in numbers:
            state = [s if rng.random() < p else not s for s, p in zip(state, (0.5, 0.97, 1.0))]
            rows.append((h, i, *state))
    return rows


def wide_of(spark, rows):
    frame = spark.createDataFrame(rows, "host string, id long, fired_1 boolean, fired_2 boolean, fired_3 boolean")
    return frame.withColumn("ts", F.expr("CAST(timestamp_seconds(id * 60) AS TIMESTAMP_NTZ)"))


def test_episodes_equal_brute_force(spark):
    for seed in range(3):
        rows = random_rows(seed)
        wide = wide_of(spark, rows)
        want = brute_force(rows, (1, 2, 3))
        for block in (1, 5, 32, 10_000):
            assert rows_of(episodes(wide, block), *COLUMNS) == want


def test_streamed_episodes_equal_batch(spark):
    rows = random_rows(9)
    state, ended = state_table(spark, "s"), output_table(spark, "e")
    step = EpisodeStep(state, ended, block=16)
    cuts = [0, 90, 91, 250, 600]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = [r for r in rows if low <= r[1] < high and not (r[0] == "b" and n == 2)]
        if n == 3:
            part += [r for r in rows if 91 <= r[1] < 250 and r[0] == "b"]
        step(wide_of(spark, part), n)
        step(wide_of(spark, part), n)  # a repeated batch changes nothing
    got = ended.all(spark).unionByName(step.still_open(spark, len(cuts) - 2).drop("ts_notified"))
    assert rows_of(got, *COLUMNS) == brute_force(rows, (1, 2, 3))


def view_of(spark, make, rule, first, last, told=False, resolved=False):
    report = make([("a", 1, 0, 1), ("a", 2, first, 1), ("a", 3, last, 1)], "v")
    runs = spark.createDataFrame([("a", 1, 2, 3, 2)], "host string, alert_condition_id int, start_id long, end_id long, fires long")
    rows = pending(runs).withColumn("resolved", F.lit(resolved))
    if told:
        rows = mark_notified(rows, rows, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return pending_view(rows, conditions_frame(spark, [rule]), report)


def test_elapsed_minutes(spark, make):
    rule = Condition(1, "v > 0", alert_delay_minutes=2)
    assert rows_of(view_of(spark, make, rule, 0, 117), "elapsed_minutes", "in_error") == [(2, True)]
    assert rows_of(view_of(spark, make, rule, 0, 116), "elapsed_minutes", "in_error") == [(1, False)]


def test_notified_alert_is_not_repeated(spark, make):
    once, again = Condition(1, "v > 0"), Condition(1, "v > 0", repetitive_alert=True)
    assert notifications(view_of(spark, make, once, 0, 60)).count() == 1
    assert notifications(view_of(spark, make, once, 0, 60, told=True)).count() == 0
    assert notifications(view_of(spark, make, again, 0, 60, told=True)).count() == 1
    assert notifications(view_of(spark, make, once, 0, 60, told=True, resolved=True)).count() == 1


def test_empty_is_true_and_null_is_false(spark, make):
    report = make([("a", 1, 0, None)], "v")
    got = evaluate(report, [Condition(1, ""), Condition(2, "v > 1"), Condition(3, "v"), Condition(4, "x", enabled=False)])
    assert rows_of(got, "alert_condition_id", "fired") == [(1, True), (2, False), (3, False)]


def test_severity_order(spark):
    rows = [(i, e, False, True, 5) for i, e in enumerate(("info", "critical", "warning"))]
    frame = spark.createDataFrame(rows, "alert_condition_id int, error_level string, resolved boolean, in_error boolean, elapsed_minutes long")
    assert [r.error_level for r in frame.orderBy(*pending_order()).collect()] == ["critical", "warning", "info"]


def test_resolve_covers_rules_that_stopped(spark):
    runs = spark.createDataFrame([("a", 1, 2, 3, 2), ("a", 2, 2, 5, 2)],
                                 "host string, alert_condition_id int, start_id long, end_id long, fires long")
    seen = spark.createDataFrame([("a", 5)], "host string, id_evaluated long")
    assert rows_of(resolve(pending(runs), seen), "alert_condition_id", "resolved") == [(1, True), (2, False)]


def test_digest_divides_open_and_resolved(spark, make):
    rule = Condition(1, "v > 0", description="One")
    open_items = notifications(view_of(spark, make, rule, 0, 60))
    done = notifications(view_of(spark, make, rule, 0, 60, resolved=True))
    text = digest(open_items.unionByName(done)).first()["digest"]
    assert text.index("ERROR: One") < text.index("-------") < text.index("Resolved: One")


def test_rules_of_one_shape_are_parsed_once(spark, monkeypatch):
    from gaugeweave.operators import alerts

    texts = [f"x > {i}" for i in range(50)] + ["x > 1234567890", "x > 12345678901", "y >> (", "y > 1e+5", "y > 1e+999", "z = '5'", "no > 3",
             "", "x > 5L", "x = CAST(y AS DECIMAL(40)) - 7", "x = CAST(y AS DECIMAL(10)) - 7", "`x > 5` > 5", "x>=007 OR z<-12", None]
    rules = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(99, "x > 1", False)],
                                  "alert_condition_id int, condition_eval string, enabled boolean")
    known = ["x", "y", "z"]
    want = {r.alert_condition_id: (list(r.columns), r.error is None) for r in alerts.rule_inputs(
        spark, [alerts.Condition(i, t) for i, t in enumerate(texts)], known)}
    parsed, read = [], alerts.rule_columns
    monkeypatch.setattr(alerts, "rule_columns", lambda spark, text: parsed.append(text) or read(spark, text))
    monkeypatch.setattr(alerts, "SHAPES", 4)
    got = {r["alert_condition_id"]: (r["columns"], r["error"] is None) for r in alerts.rule_inputs_table(rules, known).collect()}
    assert got == want and len(parsed) == len(set(parsed)) <= 16
