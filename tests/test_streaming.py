import random

from gaugeweave.catalog import DAY, HOUR, MetricCatalog
from gaugeweave.operators.delta import delta
from gaugeweave.operators.rollup import rollup
from gaugeweave.session import scratch_dir
from gaugeweave.sources.tables import read_table
from gaugeweave.streaming.deltas import TableDeltaStep
from gaugeweave.streaming.ingest import SilenceStep
from gaugeweave.streaming.rollups import RefreshStep
from gaugeweave.streaming.run import output_table, state_table
from conftest import rows_of

CAT = MetricCatalog()
COLUMNS = ("host", "ts", "id", "ts_diff_seconds", "com_select", "com_select_diff")


def test_refresh_with_late_and_repeated_batches(spark, make):
    """Samples arrive shuffled over four batches with silences of days; the table equals a full rebuild."""
    rng = random.Random(3)
    rows, at = [], 0
    for i in range(120):
        at += rng.choice([300, 600, 2000, 3 * 86400 if rng.random() < 0.1 else 900])
        rows.append(("a" if i % 3 else "b", i // 3 if i % 3 == 0 else i, at, rng.randrange(500)))
    arrivals = rows[:]
    rng.shuffle(arrivals)
    paths = {HOUR: scratch_dir(spark, "hours"), DAY: scratch_dir(spark, "days")}
    step = RefreshStep(CAT, ["com_select"], [], scratch_dir(spark, "s"), paths, shards=1)
    for n in range(4):
        batch = make(arrivals[n * 30 : (n + 1) * 30], "com_select")
        step(batch, n)
        if n == 2:
            step(batch, n)
    deltas = delta(make(rows, "com_select"), CAT, ["com_select"], [])
    for grain, path in paths.items():
        assert rows_of(read_table(spark, path), *COLUMNS) == rows_of(rollup(deltas, grain, ["com_select"]), *COLUMNS)


def test_changes_of_samples_in_any_order(spark, make):
    """Arrival 1, 2, 3, 5, 6 and then 4, 7, 8: nothing is lost, also when a batch is repeated."""
    step = TableDeltaStep(CAT, ["com_select"], [], scratch_dir(spark, "s"), state_table(spark, "noted"), shards=1)
    row = lambda i: ("a", i, i * (86_400 * 3 if i > 6 else 60), i * i)
    got = {}
    for n, ids in enumerate([(1, 2, 3, 5, 6), (4, 7, 8), (4, 6, 9)]):
        for _ in range(2):
            got[n] = rows_of(step(make([row(i) for i in ids], "com_select"), n), "id", "com_select_diff", "ts_diff_seconds")
    want = rows_of(delta(make([row(i) for i in range(1, 10)], "com_select"), CAT, ["com_select"], []), "id", "com_select_diff", "ts_diff_seconds")
    assert sorted(x for rows in got.values() for x in rows) == want
    assert [x[0] for x in got[1]] == [4, 5, 7, 8] and [x[0] for x in got[2]] == [9]


def test_a_silent_host_is_told_once_until_it_speaks(spark, make):
    silent = output_table(spark, "silent")
    step = SilenceStep(state_table(spark, "seen"), silent)
    hour = 3600
    batches = [
        [("a", 1, 0), ("b", 1, 0)],
        [("a", 2, 2 * hour)],
        [("a", 3, 3 * hour)],
        [("b", 2, 3 * hour + 60)],
        [("a", 4, 6 * hour)],
    ]
    for n, rows in enumerate(batches):
        step(make(rows), n)
        step(make(rows), n)
    got = rows_of(silent.all(spark).selectExpr("host", "date_format(ts_last, 'HH:mm') AS t"), "host", "t")
    assert got == [("b", "00:00"), ("b", "03:01")]
