"""Long and wide forms, and the custom chart tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.functions.text import joined


def to_long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(host, id, ts, variable_name, variable_value) with whole values; NULL values are kept."""
    whole = rows.select("host", "id", "ts", *[F.col(c).cast("long").alias(c) for c in columns])
    return whole.unpivot(["host", "id", "ts"], list(columns), "variable_name", "variable_value")


def history(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of each variable in time order as one list; input is a rollup, one row per bucket."""
    return to_long(rows, columns).groupBy("host", "variable_name").agg(
        F.min("id").alias("id"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        joined(F.col("variable_value").cast("string"), ",", F.col("ts")).alias("variable_values"),
    )


def chart_name(query_id: Column, chart_type: Column) -> Column:
    base = F.concat(F.lit("custom_"), query_id.cast("string"))
    return (
        F.when(chart_type == "value", base)
        .when(chart_type == "value_psec", F.concat(base, F.lit("_psec")))
        .when(chart_type == "time", F.concat(base, F.lit("_time")))
    )


def custom_registry(registry: DataFrame) -> DataFrame:
    """The registry with the chart name of each query and whether it has a chart."""
    kind = F.col("chart_type")
    return registry.withColumns(
        {
            "chart_name": chart_name(F.col("custom_query_id"), kind),
            "chart_enabled": F.when(kind == "none", 0).otherwise(1),
        }
    )


def registry_order(registry: DataFrame) -> DataFrame:
    """Display order, for the outermost step only."""
    return registry.orderBy("chart_order", "custom_query_id")


def custom_query_id(column_name: Column) -> Column:
    """Query number in a custom column name, NULL for other names."""
    digits = F.regexp_extract(column_name, r"^custom_(\d+)(_.+)?$", 1)
    return F.when(digits != "", digits.cast("int"))


def registry_fingerprint(registry: DataFrame, hosts: DataFrame) -> DataFrame:
    """Ordered ``id:type`` list per host, empty when the host has no queries."""
    item = F.concat(F.col("custom_query_id").cast("string"), F.lit(":"), F.col("chart_type"))
    lists = registry.groupBy("host").agg(
        joined(item, ",", F.col("chart_order"), F.col("custom_query_id")).alias("custom_queries")
    )
    return hosts.select("host").distinct().join(lists, "host", "left").select(
        "host", F.coalesce("custom_queries", F.lit("")).alias("custom_queries")
    )


def custom_charts(registry: DataFrame, charts: DataFrame) -> DataFrame:
    """Each enabled chart of the registry with its payloads, picked by id and type.

    ``charts`` holds (host, alias, chart, chart_extended). A query without a payload keeps NULL.
    """
    wanted = custom_registry(registry).where(F.col("chart_enabled") == 1)
    return wanted.join(charts.withColumnRenamed("alias", "chart_name"), ["host", "chart_name"], "left")


def custom_flat(charts: DataFrame, ids: Sequence[int]) -> DataFrame:
    """One row per host with the charts, names and descriptions of the given queries."""
    of = lambda i: F.col("custom_query_id") == i
    label = F.concat(F.col("description"), F.lit(" ["), F.col("chart_type"), F.lit("]"))
    aggs = []
    for i in ids:
        live = of(i) & F.col("enabled")
        aggs += [
            F.max(F.when(live, F.col("chart"))).alias(f"custom_{i}_chart"),
            F.max(F.when(live, F.col("chart_extended"))).alias(f"custom_{i}_chart_extended"),
            F.max(F.when(of(i), F.col("chart_name"))).alias(f"custom_{i}_chart_name"),
            F.max(F.when(of(i), F.col("description"))).alias(f"custom_{i}_text_description"),
            F.max(F.when(of(i), label)).alias(f"custom_{i}_description"),
        ]
    return charts.groupBy("host").agg(*aggs)
