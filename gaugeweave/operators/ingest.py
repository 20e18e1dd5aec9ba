"""Appending samples once, aligning schemas, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeweave.catalog import CUSTOM_COLUMN, MetricCatalog
from gaugeweave.functions.timefn import NTZ


# Fixed value: days a sample is kept.
RETENTION_DAYS = 182


def to_second(ts: Column) -> Column:
    return F.date_trunc("SECOND", ts).cast(NTZ)


def first_per_second(new: DataFrame) -> DataFrame:
    """One sample per (host, second), the lowest number.

    Spark keeps the first row of each group before the shuffle too, so many copies of one second
    never meet in one task.
    """
    rows = new.withColumn("ts", to_second(F.col("ts")))
    w = Window.partitionBy("host", "ts").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def append_samples(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The rows to append: first of each second, and only seconds the table does not hold yet."""
    rows = first_per_second(new)
    if existing is None:
        return rows
    return rows.join(existing.select("host", "ts"), ["host", "ts"], "left_anti")


def align_schema(df: DataFrame, cat: MetricCatalog, columns: Sequence[str]) -> DataFrame:
    """Bring a sample table to the given metric columns.

    New columns are added as NULL, columns of custom queries that no longer exist are dropped, other
    columns stay, and every metric gets its declared type.
    """
    wanted = set(columns)
    orphan = {
        c for c in df.columns
        if c not in wanted and (m := CUSTOM_COLUMN.match(c)) and m.group(2) in (None, "_time")
    }
    kept = [c for c in df.columns if c not in orphan]
    added = [c for c in columns if c not in df.columns]
    return df.select(
        *[F.col(c) if c in cat.key_columns else F.col(c).cast(cat.type_of(c)).alias(c) for c in kept],
        *[F.lit(None).cast(cat.type_of(c)).alias(c) for c in added],
    )


def align_rollup(df: DataFrame, cat: MetricCatalog, metrics: Sequence[str]) -> DataFrame:
    """Bring a rollup table to the given status metrics: values and changes, no rates."""
    wanted = [*metrics, *[f"{m}_diff" for m in metrics]]
    added = [c for c in wanted if c not in df.columns]
    return df.select("*", *[F.lit(None).cast("long").alias(c) for c in added])


def purge(rows: DataFrame, days: int = RETENTION_DAYS, *, as_of: Column) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    if days < 1:
        raise ValueError("days must be at least 1")
    return rows.where(F.col("ts") >= (as_of - F.make_dt_interval(F.lit(days))).cast(NTZ))


def purge_orphans(alerts: DataFrame, samples: DataFrame, salts: int = 16) -> DataFrame:
    """Alerts not older than the first kept sample of their host; a host without samples keeps all."""
    first = samples.groupBy("host").agg(F.min("id").alias("_first"))
    joined = join_host_facts(alerts, first, F.col("sv_report_sample_id"), salts, how="left")
    return joined.where(F.coalesce(F.col("sv_report_sample_id") >= F.col("_first"), F.lit(True))).drop("_first")


def join_host_facts(rows: DataFrame, facts: DataFrame, spread: Column, salts: int = 16,
                    how: str = "inner") -> DataFrame:
    """Join rows to one-per-host facts without gathering a busy host in one task.

    The facts are repeated once per salt and the rows of a host take their salt from ``spread``.
    The planner broadcasts the facts by itself when their measured size allows it.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["host", "_salt"], how).drop("_salt")
