"""Alert episodes of a stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.alerts import Condition, conditions_frame, episodes, notifications, with_conditions
from gaugeweave.operators.delta import BLOCK
from gaugeweave.streaming.run import BatchTable

KEYS = ["host", "alert_condition_id"]
RUN = ["start_id", "end_id", "ts_start", "ts_end", "fires"]
STATE_SCHEMA = (
    "host string, alert_condition_id int, start_id long, end_id long, ts_start timestamp_ntz, ts_end timestamp_ntz, "
    "fires long, ts_notified timestamp_ntz, closed boolean, seen_ts timestamp_ntz"
)


def merge_open(still_open: DataFrame, runs: DataFrame, seen: DataFrame) -> DataFrame:
    """Open episodes joined with the runs of the next rows; ``closed`` tells which have ended.

    ``seen`` holds (host, first_id, last_id, seen_ts) of the evaluated rows. A run that begins with the
    first row of its host continues the open episode of its rule. A host without rows changes nothing
    and has no ``seen_ts``.
    """
    known = runs.join(seen, "host")
    heads = known.where(F.col("start_id") == F.col("first_id")).select(*KEYS, *RUN)
    others = known.where(F.col("start_id") != F.col("first_id"))
    was = still_open.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in [*RUN, "ts_notified"]])
    joined = heads.join(was, KEYS, "full").join(seen, "host", "left")
    end = F.coalesce("end_id", "_end_id")
    continued = joined.select(
        *KEYS,
        F.coalesce("_start_id", "start_id").alias("start_id"),
        end.alias("end_id"),
        F.coalesce("_ts_start", "ts_start").alias("ts_start"),
        F.coalesce("ts_end", "_ts_end").alias("ts_end"),
        (F.coalesce("fires", F.lit(0)) + F.coalesce("_fires", F.lit(0))).alias("fires"),
        F.col("_ts_notified").alias("ts_notified"),
        F.coalesce(end < F.col("last_id"), F.lit(False)).alias("closed"),
        "seen_ts",
    )
    later = others.select(
        *KEYS, *RUN, F.lit(None).cast(NTZ).alias("ts_notified"), (F.col("end_id") < F.col("last_id")).alias("closed"),
        "seen_ts",
    )
    return continued.unionByName(later)


@dataclass(frozen=True)
class EpisodeStep:
    """One micro-batch of evaluated rows (wide form): ended episodes are emitted, open ones carried.

    A batch is computed once, into the state; what it ended is copied from there. Between batches only
    one row per open (host, rule) counts. With ``conditions`` the notifications due are emitted too and
    their episodes stamped with the newest evaluated time of the host.
    """

    state: BatchTable
    ended: BatchTable
    block: int = BLOCK
    conditions: Sequence[Condition] = ()
    notices: BatchTable | None = None

    def still_open(self, spark: SparkSession, number: int) -> DataFrame:
        return self.state.of(spark, number, STATE_SCHEMA).where("NOT closed").select(*KEYS, *RUN, "ts_notified")

    def __call__(self, evaluated: DataFrame, number: int) -> None:
        spark = evaluated.sparkSession
        seen = evaluated.groupBy("host").agg(
            F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("ts").alias("seen_ts"))
        merged = merge_open(self.still_open(spark, number - 1), episodes(evaluated, self.block), seen)
        if self.notices is not None:
            merged = self._notify(merged, number)
        kept = self.state.write(merged, number)
        self.ended.write(kept.where("closed").select(*KEYS, *RUN), number)

    def _notify(self, merged: DataFrame, number: int) -> DataFrame:
        shaped = merged.where("seen_ts IS NOT NULL").select(
            *KEYS, F.col("start_id").alias("sv_report_sample_id_start"), "ts_start", "ts_end", "ts_notified",
            F.col("closed").alias("resolved"))
        view = with_conditions(shaped, conditions_frame(merged.sparkSession, self.conditions))
        sent = self.notices.write(notifications(view), number)
        told = sent.select(*KEYS, F.col("sv_report_sample_id_start").alias("start_id"), F.lit(True).alias("_sent"))
        stamped = F.when(F.col("_sent"), F.col("seen_ts")).otherwise(F.col("ts_notified"))
        return merged.join(told, [*KEYS, "start_id"], "left").withColumn("ts_notified", stamped).drop("_sent")
