"""Hour and day rollups, their refresh, ten-minute averages, profiles and min/max summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.catalog import DAY, HOUR, SAMPLE, Grain
from gaugeweave.functions.numeric import mean_text, rate_text, ratio_text, round_digits
from gaugeweave.functions.timefn import NTZ, elapsed, floor_hour, floor_minutes


def bucket_start(ts: Column, grain: Grain) -> Column:
    """Start of the hour as a timestamp, of the day as a date."""
    if grain.name == HOUR.name:
        return floor_hour(ts)
    if grain.name == DAY.name:
        return F.to_date(ts)
    return floor_minutes(ts, SAMPLE.step_seconds // 60)


def bucket_end(start: Column, grain: Grain) -> Column:
    if grain.name == DAY.name:
        return F.date_add(start, 1)
    return (start + F.make_dt_interval(secs=F.lit(grain.step_seconds))).cast(NTZ)


def rollup(
    deltas: DataFrame,
    grain: Grain,
    metrics: Sequence[str],
    params: Sequence[str] = (),
    rate_mode: str | None = None,
) -> DataFrame:
    """Buckets of a grain: first sample number, summed seconds and changes, highest values.

    ``rate_mode`` adds rates: ``"ratio"`` divides the summed change by the summed seconds,
    ``"mean"`` averages the rates of the samples. Both round half away from zero.
    """
    if rate_mode not in (None, "ratio", "mean"):
        raise ValueError(f"rate_mode {rate_mode!r}")
    secs = "ts_diff_seconds"
    aggs = ["min(id) AS id", f"sum({secs}) AS {secs}"]
    aggs += [f"max(`{c}`) AS `{c}`" for c in [*metrics, *params]]
    aggs += [f"sum(`{m}_diff`) AS `{m}_diff`" for m in metrics]
    added: list[str] = []
    if rate_mode == "mean":
        for m in metrics:
            cents = ratio_text(f"{m}_diff", secs, 100)
            aggs += [f"sum({cents}) AS `_s_{m}`", f"count({cents}) AS `_n_{m}`"]
        added = [f"({ratio_text(f'_s_{m}', f'_n_{m}', 1)}) / 100 AS `{m}_psec`" for m in metrics]
    elif rate_mode == "ratio":
        added = [f"{rate_text(f'{m}_diff', secs)} AS `{m}_psec`" for m in metrics]
    grouped = deltas.groupBy("host", bucket_start(F.col("ts"), grain).alias("ts"))
    buckets = grouped.agg(*[F.expr(a) for a in aggs]).withColumn("end_ts", bucket_end(F.col("ts"), grain))
    diffs = [f"`{m}_diff`" for m in metrics]
    return buckets.selectExpr("host", "id", "ts", "end_ts", secs, *metrics, *diffs, *added, *params)


def buckets_of(rows: DataFrame, grain: Grain) -> DataFrame:
    """Distinct buckets that hold a row."""
    return rows.select("host", bucket_start(F.col("ts"), grain).alias("ts")).distinct()


def missing_buckets(deltas: DataFrame, rolled: DataFrame, grain: Grain) -> DataFrame:
    """Buckets with samples but no rollup row."""
    return buckets_of(deltas, grain).join(rolled.select("host", "ts"), ["host", "ts"], "left_anti")


def in_buckets(rows: DataFrame, buckets: DataFrame, grain: Grain) -> DataFrame:
    """Rows whose bucket is listed. The bucket is part of the join key, so a busy host spreads out."""
    keyed = rows.withColumn("_bucket", bucket_start(F.col("ts"), grain))
    wanted = buckets.select("host", F.col("ts").alias("_bucket"))
    return keyed.join(wanted, ["host", "_bucket"], "left_semi").drop("_bucket")


def refresh(
    deltas: DataFrame,
    buckets: DataFrame,
    grain: Grain,
    metrics: Sequence[str],
    params: Sequence[str] = (),
    rate_mode: str | None = None,
) -> DataFrame:
    """Recomputed rollup rows of the listed buckets only."""
    return rollup(in_buckets(deltas, buckets, grain), grain, metrics, params, rate_mode)


def backfill(
    deltas: DataFrame,
    rolled: DataFrame,
    grain: Grain,
    metrics: Sequence[str],
    params: Sequence[str] = (),
    rate_mode: str | None = None,
) -> DataFrame:
    """Rollup rows of every missing bucket, in one job."""
    return refresh(deltas, missing_buckets(deltas, rolled, grain), grain, metrics, params, rate_mode)


def replace_buckets(existing: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("host", "ts")) -> DataFrame:
    """Existing rows with those of equal key replaced by the fresh ones."""
    kept = existing.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def bucket_avg(report: DataFrame, metrics: Mapping[str, int], minutes: int = 10) -> DataFrame:
    """Averages per floor of ``minutes``; ``metrics`` maps names to their decimals."""
    return report.groupBy("host", floor_minutes(F.col("ts"), minutes).alias("ts")).agg(
        F.max("id").alias("id"), *[F.expr(f"{mean_text(m, d)} AS `{m}`") for m, d in metrics.items()]
    )


def profile_24_7(report: DataFrame, metrics: Mapping[str, int]) -> DataFrame:
    """Averages per weekday (Monday is 0) and hour of the day."""
    cell = [F.weekday("ts").alias("wd"), F.hour("ts").alias("hr")]
    return report.groupBy("host", *cell).agg(*[F.expr(f"{mean_text(m, d)} AS `{m}`") for m, d in metrics.items()])


def minmax(rows: DataFrame, metrics: Sequence[str], ts: str | None = "ts") -> DataFrame:
    """Row count, time span and the range of each metric per host, one wide row."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("count_rows")]
    if ts:
        t = F.col(ts).cast(NTZ)
        aggs += [F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"),
                 elapsed("SECOND", F.min(t), F.max(t)).alias("ts_diff_seconds")]
    for m in metrics:
        low, high = F.min(m), F.max(m)
        aggs += [low.alias(f"{m}_min"), high.alias(f"{m}_max"), round_digits(low, high).alias(f"{m}_round_digits")]
    return rows.groupBy("host").agg(*aggs)


def minmax_long(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The ranges as rows (host, metric, low, high, round_digits), for any number of metrics."""
    wide = minmax(rows, metrics, ts=None)
    entry = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}_min").cast("double").alias("low"),
            F.col(f"{m}_max").cast("double").alias("high"),
            F.col(f"{m}_round_digits").alias("round_digits"),
        )
        for m in metrics
    ]
    return wide.select("host", F.inline(F.array(*entry)))


def latest_rows(rows: DataFrame) -> DataFrame:
    """Newest row of each host; of repeated numbers one row stays.

    The numbers alone are aggregated, by hash and before the shuffle; the wide rows are neither sorted nor moved
    except the newest ones.
    """
    newest = rows.groupBy("host").agg(F.max("id").alias("id"))
    return rows.join(newest, ["host", "id"], "left_semi").dropDuplicates(["host"])
