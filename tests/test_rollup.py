from pyspark.sql import functions as F

from gaugeweave.catalog import DAY, HOUR, SAMPLE, MetricCatalog
from gaugeweave.checks.fixtures import CAT, ev_samples
from gaugeweave.operators.delta import delta
from gaugeweave.operators.rollup import rollup
from gaugeweave.operators.series import fill_gaps, ticks
from gaugeweave.session import scratch_dir
from gaugeweave.sources.tables import read_table, upsert_buckets
from conftest import rows_of

SF = "/root/testdata/sf0.001"


def test_rate_modes_differ(make):
    rows = [("a", 1, 0, 0), ("a", 2, 10, 10), ("a", 3, 100, 20)]
    deltas = delta(make(rows, "com_select"), MetricCatalog(), ["com_select"], [])
    rate = {m: rows_of(rollup(deltas, HOUR, ["com_select"], rate_mode=m), "com_select_psec") for m in ("mean", "ratio")}
    assert rate == {"mean": [(0.56,)], "ratio": [(0.2,)]}


def test_hour_sums_equal_sample_sums(spark):
    deltas = delta(ev_samples(spark, SF, ["com_select"]), CAT, ["com_select"], [])
    for grain in (HOUR, DAY):
        totals = lambda df: rows_of(df.groupBy("host").agg(F.sum("com_select_diff").alias("s")), "host", "s")
        assert totals(deltas) == totals(rollup(deltas, grain, ["com_select"]))


def test_upsert_is_idempotent_and_keeps_other_days(spark):
    path = scratch_dir(spark, "t")
    hours = rollup(delta(ev_samples(spark, SF, ["com_select"]), CAT, ["com_select"], []), HOUR, ["com_select"])
    upsert_buckets(hours, path, shards=2)
    before = rows_of(read_table(spark, path), "host", "ts", "com_select_diff")
    upsert_buckets(hours.where("ts >= '2024-01-20'"), path, shards=2)
    upsert_buckets(hours.where("ts >= '2024-01-20'"), path, shards=2)
    assert rows_of(read_table(spark, path), "host", "ts", "com_select_diff") == before


def test_gap_fill(make):
    rows = [("a", 1, 12 * 3600, 5), ("a", 2, 12 * 3600 + 1800, 7)]
    filled = fill_gaps(make(rows, "v"), SAMPLE, ["v"])
    assert rows_of(filled.fillna(-1), "timeseries_key", "v") == [(0, 5), (1, -1), (2, -1), (3, 7)]


def test_tick_limit(spark):
    span = spark.sql("SELECT 'a' AS host, TIMESTAMP_NTZ '2024-01-01 00:30:00' AS ts_min, "
                     "TIMESTAMP_NTZ '2024-03-01 00:00:00' AS ts_max")
    assert ticks(span, SAMPLE).count() == 24
    assert ticks(span, HOUR).count() == 10
    assert rows_of(ticks(span, DAY), "n")[0] == (1,)
