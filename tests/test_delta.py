import random

from gaugeweave.catalog import MetricCatalog
from gaugeweave.operators.delta import adjacent, delta, param_changes, rates, uniform_step
from conftest import rows_of

CAT = MetricCatalog()


def steps(make, rows, name="com_select", **kw):
    return rates(delta(make(rows, name), CAT, [name], [], **kw), [name])


def test_counter_step(make):
    got = rows_of(steps(make, [("a", 1, 0, 100), ("a", 2, 60, 130)]), "ts_diff_seconds", "com_select_diff", "com_select_psec")
    assert got == [(60, 30, 0.5)]


def test_counter_reset_and_gauge_fall(make):
    rows = [("a", 1, 0, 100), ("a", 2, 60, 7)]
    assert rows_of(steps(make, rows), "com_select_diff") == [(7,)]
    assert rows_of(steps(make, rows, "threads_connected"), "threads_connected_diff") == [(-93,)]


def test_null_side_and_zero_seconds(make):
    assert rows_of(steps(make, [("a", 1, 0, None), ("a", 2, 60, 7)]), "com_select_diff", "com_select_psec") == [(None, None)]
    assert rows_of(steps(make, [("a", 1, 0, 2), ("a", 2, 0, 7)]), "com_select_diff", "com_select_psec") == [(5, None)]


def test_id_gap_drops_the_row_after_it(make):
    rows = [("a", i, i, i) for i in (1, 2, 4)]
    assert rows_of(steps(make, rows), "id") == [(2,)]


def test_step_of_two(make):
    rows = [("a", i, i, i) for i in (1, 3, 5)]
    assert rows_of(steps(make, rows, step=2), "id") == [(3,), (5,)]


def test_rate_ties_go_away_from_zero(make):
    assert rows_of(steps(make, [("a", 1, 0, 0), ("a", 2, 120, 69)]), "com_select_psec") == [(0.58,)]
    gauge = steps(make, [("a", 1, 0, 69), ("a", 2, 120, 0)], "threads_connected")
    assert rows_of(gauge, "threads_connected_psec") == [(-0.58,)]


def test_large_counters_do_not_overflow(make):
    top = 2**63 - 1
    got = rows_of(steps(make, [("a", 1, 0, 0), ("a", 2, 1000, top)]), "com_select_diff", "com_select_psec")
    assert got == [(top, 9223372036854775.81)]


def test_blocks_and_join_agree_for_any_numbering(make):
    """Random gaps, hosts and block sizes: the windowed form equals the self-join by brute force."""
    rng = random.Random(5)
    for step in (1, 2, 3):
        rows = [(h, i, i * 10, rng.randrange(1000), step) for h in "abc" for i in sorted(rng.sample(range(400), 250))]
        values = {(h, i): v for h, i, _, v, _ in rows}
        want = sorted((h, i, values[h, i - step]) for h, i in values if (h, i - step) in values)
        frame = make(rows, "v", "auto_increment_increment")
        for block in (4, 7, 64, 1000):
            assert rows_of(adjacent(frame, ["v"], step, block), "host", "id", "prev_v") == want
        assert rows_of(adjacent(frame, ["v"], "auto_increment_increment"), "host", "id", "prev_v") == want
        assert uniform_step(frame, "auto_increment_increment") == step


def test_uniform_step_of_mixed_steps(make):
    assert uniform_step(make([("a", 1, 0, 1), ("a", 2, 1, 2)], "s"), "s") is None


def test_hot_host_is_split_over_partitions(spark, make):
    """One host, many blocks: no partition of the window holds more than a fair share."""
    frame = spark.range(40_000).selectExpr(
        "'hot' AS host", "id", "CAST(timestamp_seconds(id) AS TIMESTAMP_NTZ) AS ts", "id AS com_select")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = delta(frame, CAT, ["com_select"], [], block=500)
        sizes = [n for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 39_999
    assert max(sizes) < 0.5 * sum(sizes)


def test_param_changes_skip_null(make):
    rows = [("a", i, i * 60, v) for i, v in enumerate([600, 600, 650, None, 700])]
    got = rows_of(param_changes(make(rows, "max_connections"), CAT), "variable_name", "old_value", "new_value")
    assert got == [("max_connections", 600, 650)]


def test_timestamp_parameter_is_never_reported(make):
    rows = [("a", i, i, i) for i in range(3)]
    assert param_changes(make([(*r, 1) for r in rows], "timestamp", "max_connections"), CAT).count() == 0
