"""Alert episodes of rows in any order: every split, join, extension and new beginning equals all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from gaugeweave.operators.alerts import Condition, episodes
from gaugeweave.session import scratch_dir
from gaugeweave.streaming.repair import RepairStep
from gaugeweave.streaming.run import output_table

RULES = [Condition(1, "x", description="one", alert_delay_minutes=2), Condition(2, "y", description="two")]
COLUMNS = ("host", "alert_condition_id", "start_id", "end_id", "ts_start", "ts_end", "fires")


def wide(spark, rows):
    schema = "host string, id long, fired_1 boolean, fired_2 boolean"
    ts = "CAST(timestamp_seconds(1704067200 + 60 * id) AS TIMESTAMP_NTZ) AS ts"
    return spark.createDataFrame(rows, schema).selectExpr("host", "id", ts, "fired_1", "fired_2")


def step(spark, block):
    return RepairStep(scratch_dir(spark, "evaluated"), scratch_dir(spark, "runs"), RULES, output_table(spark, "notices"), block, shards=1)


def compare(spark, repair, rows):
    assert rows_of(repair.episodes(spark), *COLUMNS) == rows_of(episodes(wide(spark, rows)), *COLUMNS)
    last = {h: max(r[1] for r in rows if r[0] == h) for h in {r[0] for r in rows}}
    due = set()
    for h, c, s, e, t0, t1, _ in rows_of(episodes(wide(spark, rows)), *COLUMNS):
        if ((t1 - t0).total_seconds() + 3) // 60 >= (2 if c == 1 else 0):
            due |= {(h, c, s, False)} | ({(h, c, s, True)} if e < last[h] else set())
    standing = rows_of(repair.standing_notices(spark), "host", "alert_condition_id", "start_id", "resolved", "times")
    assert standing == sorted((*k, 1) for k in due)


@pytest.mark.parametrize("seed, block", [(1, 4), (2, 7), (3, 64)])
def test_batches_dealt_at_random(spark, seed, block):
    rng = random.Random(seed)
    rows = [(h, i, rng.random() < 0.7, rng.random() < 0.3) for h in ("a", "b") for i in rng.sample(range(40), 26)]
    rng.shuffle(rows)
    repair = step(spark, block)
    for n in range(3):
        batch = rows[n * 18 : (n + 1) * 18]
        repair(wide(spark, batch), n)
        if n == 1:
            repair(wide(spark, batch), n)  # repeated after a failure
            compare(spark, repair, rows[:36])
    compare(spark, repair, rows)


def test_a_late_quiet_row_cuts_a_run_and_withdraws_what_was_told(spark):
    repair = step(spark, 8)
    rows = [("a", i, True, False) for i in (1, 2, 4, 5)] + [("a", 6, False, False)]
    repair(wide(spark, rows), 0)
    assert rows_of(repair.standing_notices(spark), "start_id", "resolved") == [(1, False), (1, True)]
    repair(wide(spark, [("a", 3, False, False)]), 1)
    assert rows_of(repair.episodes(spark), "start_id", "end_id") == [(1, 2), (4, 5)]
    assert repair.standing_notices(spark).isEmpty()  # neither part lasts two minutes
    withdrawn = repair.notices.all(spark).where(F.col("withdrawn"))
    assert rows_of(withdrawn, "start_id", "resolved") == [(1, False), (1, True)]


def test_a_silent_stretch_of_blocks_does_not_cut(spark):
    repair = step(spark, 4)
    repair(wide(spark, [("a", 1, True, True), ("a", 90, True, True)]), 0)
    assert rows_of(repair.episodes(spark), "alert_condition_id", "start_id", "end_id", "fires", "closed") == [
        (1, 1, 90, 2, False), (2, 1, 90, 2, False)]
    repair(wide(spark, [("a", 50, False, True)]), 1)
    assert rows_of(repair.episodes(spark), "alert_condition_id", "start_id", "end_id", "fires", "closed") == [
        (1, 1, 1, 1, True), (1, 90, 90, 1, False), (2, 1, 90, 3, False)]
