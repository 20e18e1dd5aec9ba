from conftest import rows_of

from gaugeweave.catalog import HOUR
from gaugeweave.operators.rollup import rollup
from gaugeweave.streaming.late import WindowStep, rollup_parts
from gaugeweave.streaming.run import output_table, state_table

COLUMNS = ["host", "id", "ts", "end_ts", "ts_diff_seconds", "m", "m_diff"]


def steps(spark):
    return WindowStep(rollup_parts(HOUR, ["m"]), state_table(spark, "clock"), state_table(spark, "opened"),
                      output_table(spark, "closed"), output_table(spark, "late"))


def test_late_rows_are_kept_aside_and_merged(spark, make):
    make_rows = lambda rows: make(rows, "ts_diff_seconds", "m", "m_diff")
    batches = [
        [("a", 1, 60, 60, 5, 1), ("a", 2, 3000, 60, 7, 2), ("b", 1, 100, 60, None, None)],
        [("a", 5, 8000, 60, 9, 4), ("a", 3, 3500, 60, 3, 8)],  # number 3 comes before its hour is closed
        [("a", 4, 3590, 60, 99, 16), ("c", 1, 50, 60, 1, 32)],  # both behind the clock, host c for the first time
        [],
        [("a", 6, 8100, 60, 1, 64), ("a", 7, 20000, None, None, 128)],
    ]
    step = steps(spark)
    for number, rows in enumerate(batches):
        step(make_rows(rows), number)
        step(make_rows(rows), number)  # repeated
    assert rows_of(step.late.all(spark), "host", "id") == [("a", 4), ("c", 1)]
    once = rows_of(step.closed.all(spark), "host", "id", "m_diff")
    assert once == [("a", 1, 11), ("a", 5, 68), ("b", 1, None)]
    assert rows_of(step.settled(spark), "host", "id", "m_diff") == [("a", 1, 27), ("a", 5, 68), ("b", 1, None), ("c", 1, 32)]
    want = rollup(make_rows([r for b in batches for r in b]), HOUR, ["m"])
    key = lambda df: sorted(map(str, df.select(*COLUMNS).collect()))
    assert key(step.every(spark)) == key(want)


def test_no_rows_at_all(spark, make):
    step = steps(spark)
    for number in (0, 1):
        step(make([], "ts_diff_seconds", "m", "m_diff"), number)
    assert step.every(spark).isEmpty() and step.settled(spark).isEmpty()
