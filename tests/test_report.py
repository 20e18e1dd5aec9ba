from gaugeweave.catalog import CHARTS, PROFILE_METRICS, MetricCatalog
from gaugeweave.operators.delta import delta, rates
from gaugeweave.operators.report import METRICS, inputs_of, report
from conftest import rows_of

CAT = MetricCatalog()


def metric(make, name, rows):
    needs = inputs_of([name], CAT)
    frame = make(rows, *needs.metrics, *needs.params)
    view = rates(delta(frame, CAT, needs.metrics, needs.params), needs.rates)
    return rows_of(report(view, [name], CAT), name)


def test_all_metrics_are_declared():
    assert len(METRICS) == 135
    assert {s for c in CHARTS for s in c.series} <= set(METRICS)
    assert set(PROFILE_METRICS) <= set(METRICS)


def test_uptime_is_capped(make):
    assert metric(make, "uptime_percent", [("a", 1, 0, 0), ("a", 2, 60, 61)]) == [(100.0,)]
    assert metric(make, "uptime_percent", [("a", 1, 0, None), ("a", 2, 60, 61)]) == [(None,)]


def test_catch_up(make):
    name = "estimated_slave_catchup_seconds"
    assert metric(make, name, [("a", 1, 0, 130), ("a", 2, 10, 100)]) == [(33,)]
    assert metric(make, name, [("a", 1, 0, 100), ("a", 2, 10, 100)]) == [(None,)]


def test_only_needed_inputs():
    needs = inputs_of(["com_select_percent"], CAT)
    assert needs.metrics == ("com_select", "queries", "questions")
    assert needs.rates == () and needs.params == ()


def test_scan_reads_only_the_needed_columns(spark):
    from gaugeweave.checks.rollup_queries import sample_report

    plan = sample_report(spark, "/root/testdata/sf0.001", ["com_select_psec"])._jdf.queryExecution().toString()
    read = [line for line in plan.splitlines() if "ReadSchema" in line][-1]
    assert "user_id" not in read and "props" not in read
