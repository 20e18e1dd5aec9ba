"""Rollups of a stream: closed windows, and refresh of the touched buckets of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.catalog import Grain, MetricCatalog
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.delta import delta_between, followers, sample_columns
from gaugeweave.operators.ingest import append_samples
from gaugeweave.operators.rollup import buckets_of, in_buckets, rollup
from gaugeweave.session import materialize
from gaugeweave.sources.tables import append_rows, open_table, upsert_buckets
from gaugeweave.streaming.run import WATERMARK, event_time

SPANS = {"sample": "10 minutes", "hour": "1 hour", "day": "1 day"}


def closed_windows(deltas: DataFrame, grain: Grain, metrics: Sequence[str], delay: str = WATERMARK) -> DataFrame:
    """Rollup rows of a stream of deltas, each once, when the watermark has passed its end."""
    timed = event_time(deltas).withWatermark("ts", delay)
    aggs = [F.min("id").alias("id"), F.sum("ts_diff_seconds").alias("ts_diff_seconds")]
    aggs += [F.max(m).alias(m) for m in metrics] + [F.sum(f"{m}_diff").alias(f"{m}_diff") for m in metrics]
    grouped = timed.groupBy("host", F.window("ts", SPANS[grain.name]).alias("w")).agg(*aggs)
    return grouped.select(
        "host", "id", F.col("w.start").cast(NTZ).alias("ts"), F.col("w.end").cast(NTZ).alias("end_ts"),
        "ts_diff_seconds", *metrics, *[f"{m}_diff" for m in metrics],
    )


@dataclass(frozen=True)
class RefreshStep:
    """One micro-batch: append the new samples, then rewrite the rollup buckets they change.

    A late sample is also the predecessor of a stored one, so the bucket of its successor is rewritten
    as well. Only touched days are scanned; predecessors are looked up ``lookback_days`` further back,
    and the few that lie even earlier in the rest of the table. With a ``step`` column a row's predecessor is as many
    numbers lower as the row itself says.
    """

    cat: MetricCatalog
    metrics: Sequence[str]
    params: Sequence[str]
    samples_path: str
    rollup_paths: Mapping[Grain, str]
    lookback_days: int = 1
    shards: int = 16
    step: int | str = 1

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch.select(*sample_columns(self.metrics, self.params, self.step)), "arrived")
        low, high = rows.agg(F.min("ts"), F.max("ts")).first()
        if low is None:
            return
        stored = self._table(spark)
        if stored is not None:  # seconds of the batch can only be stored under the days of the batch
            stored = stored.where(F.col("day").between(F.to_date(F.lit(low)), F.to_date(F.lit(high))))
        # Written before the table changes; a repeated batch finds its seconds stored and adds nothing.
        fresh = materialize(append_samples(rows, stored), "fresh")
        append_rows(fresh, self.samples_path, self.shards)
        table = self._table(spark)
        # Of the whole batch, not of its new rows: the first attempt may have stopped after the append.
        after = followers(table.where(F.col("day") >= F.to_date(F.lit(low))), rows, self.step)
        changed = materialize(rows.select("host", "ts").unionByName(after.select("host", "ts")), "changed")
        for grain, path in self.rollup_paths.items():
            self._refresh(table, changed, grain, path)

    def _refresh(self, table: DataFrame, changed: DataFrame, grain: Grain, path: str) -> None:
        touched = materialize(buckets_of(changed, grain), "touched")
        first, last = touched.agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
        inside = table.where(F.col("day").between(F.lit(first), F.lit(last)))
        current = in_buckets(inside, touched, grain)
        near_from = F.date_sub(F.lit(first), self.lookback_days)
        deltas = self._deltas(current, table.where(F.col("day") >= near_from))
        alone = materialize(current.join(deltas.select("host", "id"), ["host", "id"], "left_anti"), "unpaired")
        if not alone.isEmpty():
            deltas = deltas.unionByName(self._deltas(alone, table.where(F.col("day") < near_from)))
        upsert_buckets(rollup(deltas, grain, self.metrics, self.params), path, self.shards)

    def _deltas(self, current: DataFrame, earlier: DataFrame) -> DataFrame:
        return delta_between(current, earlier, self.cat, self.metrics, self.params, self.step)

    def _table(self, spark: SparkSession) -> DataFrame | None:
        return open_table(spark, self.samples_path)
