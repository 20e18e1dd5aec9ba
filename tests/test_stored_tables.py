"""Tables on storage: columns that appear later, interrupted upserts, folders, errors."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gaugeweave.operators.alerts import Condition, evaluate, mark_notified
from gaugeweave.operators.rollup import latest_rows
from gaugeweave.functions.text import cut, trimmed
from gaugeweave.sources import tables
from gaugeweave.sources.tables import append_rows, drop_old_days, open_table, read_table, scan_samples, upsert_buckets
from conftest import rows_of

DAY = 86_400


def test_a_column_that_appears_later_is_read_and_kept(make, tmp_path):
    path = str(tmp_path / "t")
    append_rows(make([("a", 1, 0, 5), ("a", 2, 3600, 6)], "m"), path, shards=1)
    append_rows(make([("a", 3, 7200, 7, 70)], "m", "newer"), path, shards=1)
    spark = make([], "m").sparkSession
    assert rows_of(read_table(spark, path).na.fill(0), "id", "m", "newer") == [(1, 5, 0), (2, 6, 0), (3, 7, 70)]
    upsert_buckets(make([("a", 1, 0, 50)], "m"), path, shards=1)
    assert rows_of(read_table(spark, path).na.fill(0), "id", "m", "newer") == [(1, 50, 0), (2, 6, 0), (3, 7, 70)]


def test_an_interrupted_upsert_is_repeated(make, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert_buckets(make([("a", 1, 0, 5), ("a", 2, 3600, 6)], "m"), path, shards=1)

    def dies(placed, at, folders):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(tables, "_overwrite_folders", dies)
        with pytest.raises(RuntimeError):
            upsert_buckets(make([("a", 2, 3600, 60)], "m"), path, shards=1)
    spark = make([], "m").sparkSession
    assert rows_of(read_table(spark, path), "id", "m") == [(1, 5), (2, 6)]
    upsert_buckets(make([("a", 9, 2 * DAY, 9)], "m"), path, shards=1)
    assert rows_of(read_table(spark, path), "id", "m") == [(1, 5), (2, 60), (9, 9)]


def test_errors_other_than_a_missing_table_are_raised(make, tmp_path):
    spark = make([], "m").sparkSession
    assert open_table(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        open_table(spark, str(tmp_path / "broken")).count()


def test_a_time_filter_reads_only_its_days(make, tmp_path):
    path = str(tmp_path / "t")
    append_rows(make([("a", i, i * DAY, i) for i in range(6)], "m"), path, shards=1)
    table = open_table(make([], "m").sparkSession, path)
    since, until = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz") for d in (3, 5))
    got = scan_samples(table, ["m"], since, until)
    assert rows_of(got, "m") == [(2,), (3,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_old_days_are_dropped_as_folders(make, tmp_path):
    path = str(tmp_path / "t")
    append_rows(make([("a", i, i * DAY, i) for i in range(4)], "m"), path, shards=1)
    spark = make([], "m").sparkSession
    assert drop_old_days(spark, path, date(2024, 1, 3)) == ["day=2024-01-01", "day=2024-01-02"]
    assert rows_of(read_table(spark, path), "m") == [(2,), (3,)]


def test_newest_rows_without_a_sort_of_the_table(make):
    rows = make([("a", 1, 0, 5), ("a", 3, 9, 6), ("b", 2, 5, None)], "m")
    assert rows_of(latest_rows(rows), "host", "id") == [("a", 3), ("b", 2)]
    assert "SortAggregate" not in latest_rows(rows)._jdf.queryExecution().executedPlan().toString()


def test_a_rule_that_cannot_be_computed_is_false(make):
    report = make([("a", 1, 0, 4, 0), ("a", 2, 1, 4, 2)], "x", "y")
    rules = [Condition(1, "x / y > 1"), Condition(2, "''"), Condition(3, "x % y = 0"), Condition(4, "CAST('no' AS INT) > 0"), Condition(5, "x > 3")]
    fired = {(r["id"], r["alert_condition_id"]): r["fired"] for r in evaluate(report, rules).collect()}
    assert [fired[1, i] for i in range(1, 6)] == [False, False, False, False, True]
    assert [fired[2, i] for i in range(1, 6)] == [True, False, True, False, True]


def test_only_the_episode_that_was_sent_is_stamped(spark):
    schema = "host string, alert_condition_id int, sv_report_sample_id_start long, ts_notified timestamp_ntz"
    rows = spark.createDataFrame([("a", 1, 10, None), ("a", 1, 20, None)], schema)
    told = mark_notified(rows, rows.where("sv_report_sample_id_start = 20"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    assert [r["ts_notified"] is not None for r in told.orderBy("sv_report_sample_id_start").collect()] == [False, True]


def test_texts_of_narrow_and_large_values(spark):
    rows = spark.createDataFrame([(1.2e-7, 9), (1e18, 2), (3.5e25, 1), (2.0, 7), (2.345678, 2), (-1e33, 1)], "v double, d int")
    got = [r[0] for r in rows.select(cut(F.col("v"), F.col("d"))).collect()]
    assert got == ["0.000000120", "1000000000000000000.00", "35000000000000000000000000.0", "2.0000000", "2.34", "-1000000000000000000000000000000000.0"]
    got = [r[0] for r in rows.select(trimmed(F.col("v"))).collect()]
    assert got[:4] == ["0", "1000000000000000000", "35000000000000000000000000", "2"]


def test_an_upsert_needs_no_success_markers_and_ignores_a_torn_journal(make, tmp_path):
    path, spark = str(tmp_path / "t"), make([], "m").sparkSession
    conf = spark._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        upsert_buckets(make([("a", 1, 0, 5), ("a", 2, 3600, 6)], "m"), path, shards=1)
        upsert_buckets(make([("a", 2, 3600, 60)], "m"), path, shards=1)
        assert rows_of(read_table(spark, path), "id", "m") == [(1, 5), (2, 60)]
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    # Rows of a journal that was never marked complete.
    tables._placed(make([("a", 2, 3600, 99)], "m"), 1).write.parquet(f"{path}/{tables.JOURNAL}")
    upsert_buckets(make([("a", 9, 2 * DAY, 9)], "m"), path, shards=1)
    assert rows_of(read_table(spark, path), "id", "m") == [(1, 5), (2, 60), (9, 9)]


def test_a_table_records_its_schema_and_opens_no_footer(make, tmp_path):
    path, spark = str(tmp_path / "t"), make([], "m").sparkSession
    append_rows(make([("a", 1, 0, 5)], "m"), path, shards=1)
    wide = make([("a", 2, 60, 0, 7)], "m", "newer").withColumn("m", F.lit("18446744073709551615").cast("decimal(20,0)"))
    append_rows(wide, path, shards=1)
    append_rows(make([("a", 3, 120, 8)], "m"), path, shards=1)
    known = {f.name: f.dataType.simpleString() for f in tables.stored_schema(spark, path).fields}
    assert known["m"] == "decimal(20,0)" and known["newer"] == "bigint" and list(known)[-1] == "newer"
    got = rows_of(read_table(spark, path).na.fill(0), "id", "m", "newer")
    assert [(i, int(m), n) for i, m, n in got] == [(1, 5, 0), (2, 18446744073709551615, 7), (3, 8, 0)]
    with pytest.raises(ValueError, match="stored as"):
        append_rows(make([("a", 4, 180, 8)], "m").withColumn("m", F.lit("text")), path, shards=1)


def test_all_hosts_in_one_scan(make, tmp_path):
    spark, names = make([], "m").sparkSession, [f"h {i}+é%" if i == 7 else f"h{i}" for i in range(200)]
    import pandas as pd

    for i, name in enumerate(names):
        (tmp_path / name).mkdir()
        pd.DataFrame({"id": [i, i + 1], "m": [i, -i]} if i % 2 else {"id": [i]}).to_parquet(tmp_path / name / "part-0.parquet")
    got = tables.read_hosts(spark, str(tmp_path), "host string, id long, m long")
    expected = [(h, j, m) for i, h in enumerate(names) for j, m in ([(i, i), (i + 1, -i)] if i % 2 else [(i, None)])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_good_rules_fire_beside_bad_ones(make):
    from gaugeweave.operators.alerts import rule_inputs, watched_metrics

    report = make([("a", 1, 0, 4, 1)], "x", "y")
    rules = [Condition(1, "nosuch > 1"), Condition(2, "x >> ("), Condition(3, "sum(x) > 1"), Condition(4, "X > y"), Condition(5, "explode(array(x, y))")]
    fired = {r["alert_condition_id"]: r["fired"] for r in evaluate(report, rules).collect()}
    assert fired == {1: False, 2: False, 3: False, 4: True, 5: False}
    found = {r.alert_condition_id: r for r in rule_inputs(report.sparkSession, rules, ["x", "y", "z"])}
    assert found[4].columns == ("x", "y") and found[4].error is None
    assert "nosuch" in found[1].error and found[2].error
    assert watched_metrics(report.sparkSession, rules[:2] + rules[3:4], ["z", "y", "x"]) == ["y", "x"]


def test_decimals_are_cut_never_rounded(spark):
    cases = [(0.9999999, 1, "0.9"), (123.4567899, 6, "123.456789"), (1.25e-20, 21, "0.000000000000000000012"), (0.999999999999, 6, "0.999999"),
             (-0.05, 1, "-0.0"), (1e22, 3, "10000000000000000000000.000"), (0.1, 20, "0.10000000000000000000"), (5e-324, 3, "0.000"), (None, 2, None),
             (float("inf"), 2, None), (float("nan"), 2, None), (12.5, 0, "12.")]
    rows = spark.createDataFrame([c[:2] for c in cases], "v double, d int")
    assert [r[0] for r in rows.select(cut(F.col("v"), F.col("d"))).collect()] == [c[2] for c in cases]
