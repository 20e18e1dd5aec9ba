"""Samples from a stream: one per host and second, and hosts that fell silent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.functions.timefn import NTZ
from gaugeweave.streaming.run import WATERMARK, BatchTable, event_time

SEEN_SCHEMA = "host string, ts_last timestamp_ntz"


def unique_seconds(stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """One sample per (host, second). Which copy survives is not fixed, the keys are."""
    timed = event_time(stream).withColumn("ts", F.date_trunc("SECOND", "ts"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["host", "ts"])


@dataclass(frozen=True)
class SilenceStep:
    """One micro-batch: hosts whose newest sample lies ``after_seconds`` behind the event clock.

    The clock is the newest sample of all hosts less the delay allowed for late ones. The state is one
    row per host, fed by a partial aggregation, so a busy host costs no more than a quiet one. A host
    is told once until it speaks again.
    """

    seen: BatchTable
    silent: BatchTable
    after_seconds: int = 3600
    delay_seconds: int = 600

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = self.seen.of(batch.sparkSession, number - 1, SEEN_SCHEMA)
        heard = batch.select("host", F.col("ts").cast(NTZ).alias("ts_last"))
        newest = before.unionByName(heard).groupBy("host").agg(F.max("ts_last").alias("ts_last"))
        now = self.seen.write(newest, number)
        # What the state before calls silent was told then, unless the host has spoken since.
        fresh = self._overdue(now).join(self._overdue(before), ["host", "ts_last"], "left_anti")
        self.silent.write(fresh, number)

    def _overdue(self, seen: DataFrame) -> DataFrame:
        newest = seen.agg(F.max("ts_last")).first()[0]
        allowed = F.make_dt_interval(secs=F.lit(self.after_seconds + self.delay_seconds))
        return seen.where(F.col("ts_last") <= (F.lit(newest).cast(NTZ) - allowed).cast(NTZ))
