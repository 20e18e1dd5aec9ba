"""Registered scalar queries, their results in samples, and registry order."""

from pyspark.sql import functions as F

from gaugeweave.catalog import MetricCatalog
from gaugeweave.checks.fixtures import ev_samples
from gaugeweave.checks.oracle import samples_sql
from gaugeweave.checks.registry import Family
from gaugeweave.checks.rollup_queries import REGISTRY_SQL, supplier_registry
from gaugeweave.checks.series_queries import NAME_SQL
from gaugeweave.operators.custom import CustomQuery, attach_custom, run_custom
from gaugeweave.operators.reshape import custom_registry, registry_order

FAMILY = Family()
SCALARS = {
    1: "SELECT count(*) FROM {orders} WHERE o_orderstatus = 'F'",
    2: "SELECT sum(o_orderkey) FROM {orders}",
    3: "SELECT max(o_custkey) FROM {orders} WHERE o_orderkey < 0",
}
BROKEN = {
    4: "SELECT o_custkey FROM {orders}",
    5: "SELECT count(*), 1 FROM {orders}",
    6: "SELECT no_such_column FROM {orders}",
    7: "SELECT max(o_orderpriority) FROM {orders}",
}


def scalar_results(spark, sf):
    orders = f"parquet.`{sf}/orders.parquet`"
    texts = {**SCALARS, **BROKEN, 8: SCALARS[1]}
    return run_custom(spark, [CustomQuery(i, t.format(orders=orders), enabled=i != 8) for i, t in texts.items()])


@FAMILY.add(
    "i1_run_custom",
    " UNION ALL ".join(
        f"SELECT {i} AS custom_query_id, CAST(({t.format(orders='orders')}) AS BIGINT) AS value" for i, t in SCALARS.items()
    ),
)
def i1(spark, sf):
    return scalar_results(spark, sf).drop("time_ms")


@FAMILY.add("i2_custom_timing")
def i2(spark, sf):
    return scalar_results(spark, sf).select("custom_query_id", "time_ms")


# Results per host for its newest sample, measured from the events of the host.
@FAMILY.add(
    "i3_attach_custom",
    f"WITH {samples_sql(['custom_1', 'custom_1_time'])}, newest AS (SELECT host, max(id) AS id, count(*) AS n FROM samples "
    "GROUP BY host) SELECT s.host AS host, s.id AS id, ts, CASE WHEN n IS NULL THEN custom_1 ELSE n END AS custom_1, "
    "CASE WHEN n IS NULL THEN custom_1_time ELSE 12 END AS custom_1_time, CAST(NULL AS BIGINT) AS custom_3, "
    "CASE WHEN n IS NULL THEN NULL ELSE CAST(7 AS BIGINT) END AS custom_3_time FROM samples s LEFT JOIN newest USING (host, id)",
)
def i3(spark, sf):
    # custom_9 belongs to a query that is gone and is dropped; query 3 is new and returned NULL.
    samples = ev_samples(spark, sf, ["custom_1", "custom_1_time"]).withColumn("custom_9", F.lit(1).cast("long"))
    newest = samples.groupBy("host").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    results = newest.selectExpr(
        "host", "id", "inline(array(struct(1 AS custom_query_id, n AS value, 12L AS time_ms), "
        "struct(3 AS custom_query_id, CAST(NULL AS BIGINT) AS value, 7L AS time_ms)))")
    return attach_custom(samples, results, MetricCatalog(custom_ids=(1, 3)))


@FAMILY.add(
    "i4_registry_view",
    f"WITH {REGISTRY_SQL} SELECT *, {NAME_SQL} AS chart_name, CAST(CASE chart_type WHEN 'none' THEN 0 ELSE 1 END AS INTEGER) "
    "AS chart_enabled FROM registry ORDER BY chart_order, custom_query_id",
)
def i4(spark, sf):
    return registry_order(custom_registry(supplier_registry(spark, sf)))


@FAMILY.add(
    "a16_enabled_dimensions",
    f"WITH {REGISTRY_SQL} SELECT * FROM registry WHERE enabled",
)
def a16(spark, sf):
    from gaugeweave.sources.tables import enabled

    return enabled(supplier_registry(spark, sf))
