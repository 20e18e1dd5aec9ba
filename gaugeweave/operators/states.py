"""Small tables kept beside samples and rollups: masks of hours, mergeable parts of averages and ranges, newest rows.

Each can be merged from parts in any order and brought up to date from the rows of a batch alone, so what is read from
them reads no samples. The part of a bucket is replaced as a whole: repeating a batch leaves the same table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.catalog import SAMPLE
from gaugeweave.functions.numeric import round_digits, units_text
from gaugeweave.functions.timefn import NTZ, elapsed
from gaugeweave.operators.delta import latest
from gaugeweave.operators.rollup import bucket_start, buckets_of, in_buckets
from gaugeweave.session import materialize
from gaugeweave.sources.tables import FOLDERS, open_table, recover, replace_rows, shard_of, upsert_buckets


def hour_masks(rows: DataFrame) -> DataFrame:
    """(host, day as ``ts``, mask): one bit for each hour of the day with a row. Works on samples and on hour rollups."""
    bit = F.expr("shiftleft(1, hour(ts))")
    return rows.groupBy("host", F.to_date("ts").alias("ts")).agg(F.bit_or(bit).cast("int").alias("mask"))


def merge_masks(masks: DataFrame) -> DataFrame:
    return masks.groupBy("host", "ts").agg(F.bit_or("mask").cast("int").alias("mask"))


def hours_of(masks: DataFrame) -> DataFrame:
    """The hours of masks as buckets (host, ts)."""
    hours = F.expr("filter(sequence(0, 23), h -> shiftright(mask, h) & 1 = 1)")
    rows = masks.select("host", "ts", F.explode(hours).alias("_hour"))
    return rows.select("host", (F.col("ts").cast(NTZ) + F.make_dt_interval(hours=F.col("_hour"))).cast(NTZ).alias("ts"))


def missing_hours(present: DataFrame, rolled: DataFrame) -> DataFrame:
    """Hours in the mask of what is there but not in that of the rollup; only masks are read."""
    done = rolled.select("host", "ts", F.col("mask").alias("_done"))
    left = F.expr("mask & ~coalesce(_done, 0)").cast("int")
    both = present.join(done, ["host", "ts"], "left")
    return hours_of(both.select("host", "ts", left.alias("mask")).where("mask <> 0"))


def note_hours(rows: DataFrame, path: str, shards: int = 16) -> None:
    """Add the hours of rows to a stored table of masks; only the days of the rows are read and rewritten."""
    spark = rows.sparkSession
    recover(spark, path)
    fresh = materialize(hour_masks(rows), "hours")
    stored = open_table(spark, path)
    if stored is not None:
        keys = fresh.select("host", "ts", F.col("ts").alias("day"), shard_of(F.col("host"), shards).alias("shard"))
        touched = stored.join(keys, ["host", "ts", *FOLDERS], "left_semi")
        fresh = materialize(merge_masks(fresh.unionByName(touched.select("host", "ts", "mask"))), "hours")
    upsert_buckets(fresh, path, shards)


def states(report: DataFrame, metrics: Mapping[str, int]) -> DataFrame:
    """Parts of ten minutes: rows, newest number, and for each metric its sum in whole units and its count.

    ``metrics`` maps names to their decimals. Whole units add up to the same sum in any order.
    """
    aggs = [F.count(F.lit(1)).alias("count_rows"), F.max("id").alias("id")]
    for m, d in metrics.items():
        aggs += [F.expr(f"sum({units_text(m, d)}) AS `{m}_units`"), F.count(m).alias(f"{m}_count")]
    return report.groupBy("host", bucket_start(F.col("ts"), SAMPLE).alias("ts")).agg(*aggs)


def _average(m: str, digits: int, merged: bool) -> str:
    units, count = (f"sum(`{m}_units`)", f"sum(`{m}_count`)") if merged else (f"`{m}_units`", f"`{m}_count`")
    return f"({units} / nullif({count}, 0) / {float(10**digits)}D)"


def averages(parts: DataFrame, metrics: Mapping[str, int]) -> DataFrame:
    """The ten-minute averages that parts stand for."""
    return parts.selectExpr("host", "ts", "id", *[f"{_average(m, d, False)} AS `{m}`" for m, d in metrics.items()])


def profile_of(parts: DataFrame, metrics: Mapping[str, int]) -> DataFrame:
    """Averages per weekday (Monday is 0) and hour of the day, from parts."""
    cell = [F.weekday("ts").alias("wd"), F.hour("ts").alias("hr")]
    return parts.groupBy("host", *cell).agg(*[F.expr(f"{_average(m, d, True)} AS `{m}`") for m, d in metrics.items()])


def ranges_of(parts: DataFrame, metrics: Mapping[str, int]) -> DataFrame:
    """Row count, time span and range of the ten-minute averages of each host, from parts."""
    aggs = [F.count(F.lit(1)).alias("count_rows"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"),
            elapsed("SECOND", F.min("ts"), F.max("ts")).alias("ts_diff_seconds")]
    for m in metrics:
        low, high = F.min(m), F.max(m)
        aggs += [low.alias(f"{m}_min"), high.alias(f"{m}_max"), round_digits(low, high).alias(f"{m}_round_digits")]
    return averages(parts, metrics).groupBy("host").agg(*aggs)


def refresh_states(report: DataFrame, changed: DataFrame, metrics: Mapping[str, int], path: str, shards: int = 16) -> None:
    """Replace the stored parts of the slots that ``changed`` rows (host, ts) lie in.

    ``report`` holds all rows of those slots; others are not read if the table they come from is cut by day.
    """
    slots = materialize(buckets_of(changed, SAMPLE), "slots")
    upsert_buckets(materialize(states(in_buckets(report, slots, SAMPLE), metrics), "states"), path, shards)


@dataclass(frozen=True)
class NewestIndex:
    """Newest sample number and time of each host, as a table of one row for each host.

    ``note`` takes rows in any order, once or more often; ``retire`` forgets hosts whose samples have all been purged.
    """

    path: str
    shards: int = 16

    def _placed(self, hosts: DataFrame) -> DataFrame:
        return hosts.select("host", "id_latest", "ts_latest", shard_of(F.col("host"), self.shards).alias("shard"))

    def note(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        recover(spark, self.path, ["shard"])
        fresh = materialize(self._placed(latest(rows)), "newest")
        stored = open_table(spark, self.path)
        if stored is not None:
            known = stored.join(fresh.select("shard", "host"), ["shard", "host"], "left_semi")
            every = fresh.unionByName(known).groupBy("host", "shard")
            fresh = materialize(every.agg(F.max("id_latest").alias("id_latest"), F.max("ts_latest").alias("ts_latest")), "newest")
        replace_rows(fresh, fresh.select("host", "shard"), self.path, ["host"], ["shard"])

    def retire(self, spark: SparkSession, first: date) -> None:
        """Hosts without a sample since ``first``, the first day that is kept, stay known but have no newest row."""
        recover(spark, self.path, ["shard"])
        stored = open_table(spark, self.path)
        if stored is None:
            return
        gone = stored.where(F.col("ts_latest") < F.lit(first)).select("host", "shard")
        gone = materialize(gone.selectExpr("host", "CAST(NULL AS BIGINT) AS id_latest", "CAST(NULL AS TIMESTAMP_NTZ) AS ts_latest", "shard"), "retired")
        if not gone.isEmpty():
            replace_rows(gone, gone.select("host", "shard"), self.path, ["host"], ["shard"])

    def table(self, spark: SparkSession) -> DataFrame:
        """(host, id_latest, ts_latest) of every host that has samples."""
        stored = open_table(spark, self.path)
        if stored is None:
            raise FileNotFoundError(self.path)
        return stored.where("id_latest IS NOT NULL").select("host", "id_latest", "ts_latest")
