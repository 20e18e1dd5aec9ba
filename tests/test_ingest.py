import pytest
from pyspark.sql import functions as F

from gaugeweave.catalog import MetricCatalog
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.custom import CustomQuery, run_custom
from gaugeweave.operators.ingest import align_schema, append_samples, first_per_second, purge
from gaugeweave.operators.reshape import chart_name, custom_query_id
from gaugeweave.sources.hosts import mount_usage
from gaugeweave.sources.snapshots import normalize_value
from conftest import rows_of

CAT = MetricCatalog()


def test_first_of_a_second_is_kept(make):
    assert rows_of(first_per_second(make([("a", 2, 5, 20), ("a", 1, 5, 10), ("b", 3, 5, 30)], "v")), "host", "id") == [
        ("a", 1), ("b", 3)]


def test_append_twice_adds_nothing(make):
    rows = make([("a", 1, 5, 10), ("a", 2, 6, 20)], "v")
    stored = append_samples(rows)
    assert append_samples(rows, stored).count() == 0


def test_copies_of_one_second_are_reduced_before_the_shuffle(spark, make):
    plan = first_per_second(make([("a", 1, 5, 10)], "v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name, text, number", [
    ("x", "ON", 1), ("x", "no", 0), ("x", "Not Started", 0), ("x", "started", 1), ("x", "demand", 2), ("x", "12", 12),
    ("x", "", None), ("x", "text", None), ("x", None, None), ("concurrent_insert", "AUTO", 1),
    ("concurrent_insert", "always", 2), ("delay_key_write", "all", 2), ("x", "all", None),
    ("max_join_size", "18446744073709551615", 18446744073709551615),
])
def test_normalize(spark, name, text, number):
    frame = spark.createDataFrame([(name, text)], "n string, v string")
    got = frame.select(normalize_value(F.col("n"), F.col("v")).alias("x")).first().x
    assert (None if got is None else int(got)) == number


def test_mount_usage(spark):
    lit = lambda v: F.lit(v).cast("long")
    row = spark.range(1).select(mount_usage(lit(10), lit(9), lit(2)).alias("a"),
                                mount_usage(lit(0), lit(0), lit(0)).alias("b")).first()
    assert (row.a, row.b) == (34, None)


def test_align_schema(make):
    frame = make([("a", 1, 0, 1, 2, 3)], "com_select", "custom_1", "custom_7_time")
    assert align_schema(frame, CAT, ["com_select", "custom_1", "queries"]).columns == [
        "host", "id", "ts", "com_select", "custom_1", "queries"]


def test_purge_needs_a_day(make):
    rows = make([("a", 1, 0, 1), ("a", 2, 86400 * 3, 1)], "v")
    moment = F.lit("2024-01-04 12:00:00").cast(NTZ)
    assert rows_of(purge(rows, 1, as_of=moment), "id") == [(2,)]
    with pytest.raises(ValueError):
        purge(rows, 0, as_of=moment)


def test_custom_names(spark):
    kinds = {"value": "custom_3", "value_psec": "custom_3_psec", "time": "custom_3_time", "none": None}
    for kind, name in kinds.items():
        assert spark.range(1).select(chart_name(F.lit(3), F.lit(kind)).alias("n")).first().n == name
    for name, number in {"custom_12_time": 12, "custom_4": 4, "custom_": None, "uptime": None}.items():
        assert spark.range(1).select(custom_query_id(F.lit(name)).alias("n")).first().n == number


def test_custom_queries_of_the_wrong_shape_are_skipped(spark):
    texts = ["SELECT 7", "SELECT CAST(NULL AS INT)", "SELECT 1, 2", "SELECT explode(array(1, 2))", "SELECT 'x'", "SELECT oops"]
    got = run_custom(spark, [CustomQuery(i, t) for i, t in enumerate(texts)])
    assert sorted((r.custom_query_id, r.value) for r in got.collect()) == [(0, 7), (1, None)]


def test_observed_names_become_columns_with_their_types(spark):
    from gaugeweave.catalog import MetricCatalog
    from gaugeweave.sources.snapshots import observed, snapshot_to_samples, wanted

    big = str((1 << 64) - 1)
    raw = spark.createDataFrame(
        [("a", 1, "status", " New_One ", "5"), ("a", 1, "status", "Ssl_x", "5"), ("a", 2, "status", "Huge", big), ("a", 2, "status", "Open_Tables", "-3"),
         ("a", 2, "variables", "unknown_variable", "1"), ("a", 2, "variables", "Max_Connections", "9")],
        "host string, snapshot_id long, kind string, name string, value string").selectExpr(
        "host", "snapshot_id", "CAST(timestamp_seconds(snapshot_id) AS TIMESTAMP_NTZ) AS ts", "kind", "name", "value")
    cat = MetricCatalog()
    assert observed(wanted(raw, cat), cat) == {"huge": "decimal(20,0)", "max_connections": "long", "new_one": "long", "open_tables": "long"}
    samples = snapshot_to_samples(raw, cat, expected=["queries"])
    assert sorted(samples.columns) == ["host", "huge", "id", "max_connections", "new_one", "open_tables", "queries", "ts"]
    first, second = samples.orderBy("id").collect()
    assert (first["new_one"], first["huge"], second["huge"], second["open_tables"], second["queries"]) == (5, None, int(big), -3, None)
    with pytest.raises(ValueError, match="more than 2"):
        observed(wanted(raw, cat), cat, limit=2)
    assert observed(wanted(raw.limit(0), cat), cat) == {}


def test_only_wide_metrics_are_read_as_decimals(spark):
    from gaugeweave.catalog import MetricCatalog
    from gaugeweave.sources.snapshots import observed, snapshot_to_samples, wanted

    cat = MetricCatalog()
    values = {"by_digits": "9223372036854775808", "by_exponent": "1E19", "last_long": "9223372036854775807", "word": "ON", "none": None, "text": "never"}
    raw = spark.createDataFrame(
        [("h", 1, None, "status", n, v) for n, v in values.items()],
        "host string, snapshot_id long, ts timestamp_ntz, kind string, name string, value string")
    wide = {"by_digits", "by_exponent"}
    assert observed(wanted(raw, cat), cat) == {n: "decimal(20,0)" if n in wide else "long" for n in sorted(values)}
    samples = snapshot_to_samples(raw, cat, expected=[])
    (row,) = samples.collect()
    got = {n: row[n] for n in values}
    assert got == {"by_digits": 2**63, "by_exponent": 10**19, "last_long": 2**63 - 1, "word": 1, "none": None, "text": None}
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN name#" in plan.split(" AS _decimal")[0].rsplit(" AS _long", 1)[1]
