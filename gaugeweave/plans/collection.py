"""One collection run over samples in any order: custom values, store, roll up, log and repair alerts, purge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.catalog import DAY, HOUR, MetricCatalog
from gaugeweave.operators.alerts import Condition, alert_events, evaluate_wide, fired_long, watched_metrics
from gaugeweave.operators.custom import CustomQuery, run_pool
from gaugeweave.operators.delta import rates
from gaugeweave.operators.ingest import RETENTION_DAYS
from gaugeweave.operators.report import METRICS, inputs_of, report
from gaugeweave.session import materialize
from gaugeweave.sources.tables import append_rows, drop_old_days, open_table, read_table
from gaugeweave.streaming.deltas import TableDeltaStep
from gaugeweave.streaming.repair import RepairStep
from gaugeweave.streaming.rollups import RefreshStep
from gaugeweave.streaming.run import BatchTable, each_batch


@dataclass(frozen=True)
class CollectionRun:
    """Tables under one shared root and what a batch of samples goes through; a batch that is repeated changes nothing.

    Rules look at stored samples only, so a second sample of one second is no alert, and at rows in any order. The report
    metrics that rules need are read out of their texts. ``custom`` queries run at the same time, each with its own time
    limit, and their values go to the newest sample of each host in the batch.
    """

    root: str
    cat: MetricCatalog
    metrics: Sequence[str]
    params: Sequence[str] = ()
    conditions: Sequence[Condition] = ()
    host_facts: DataFrame | None = None
    custom: Sequence[CustomQuery] = ()
    custom_seconds: float = 60.0
    keep_days: int = RETENTION_DAYS
    step: int | str = 1
    block: int = 16_384
    shards: int = 16

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def repair(self) -> RepairStep:
        return RepairStep(self.path("evaluated"), self.path("runs"), self.conditions, BatchTable(self.path("notices")),
                          self.block, self.shards)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        watched = watched_metrics(spark, self.conditions, METRICS)
        needs = inputs_of(watched, self.cat)
        metrics = list(dict.fromkeys([*self.metrics, *needs.metrics, *(self.cat.custom_columns() if self.custom else [])]))
        params = list(dict.fromkeys([*self.params, *needs.params]))
        rows = materialize(self._with_custom(batch), "collected")
        newest = rows.agg(F.to_date(F.max("ts"))).first()[0]
        if newest is None:
            return
        store = TableDeltaStep(self.cat, metrics, params, self.path("samples"), BatchTable(self.path("noted"), slots=2),
                               shards=self.shards, step=self.step)
        changes = materialize(store(rows, number), "changes")
        RefreshStep(self.cat, metrics, params, self.path("samples"), {HOUR: self.path("hour"), DAY: self.path("day")},
                    shards=self.shards, step=self.step)(rows, number)
        if self.conditions:
            found = report(rates(changes, needs.rates), watched, self.cat)
            evaluated = materialize(evaluate_wide(found, self.conditions, self.host_facts), "evaluated")
            self._log(evaluated)
            self.repair(evaluated, number)
        self._purge(spark, newest)  # last: the steps above would store a batch's old rows again

    def _with_custom(self, batch: DataFrame) -> DataFrame:
        if not self.custom:
            return batch
        values = run_pool(batch.sparkSession, self.custom, seconds=self.custom_seconds)
        newest = batch.groupBy("host").agg(F.max("id").alias("_newest"))
        marked = batch.drop(*self.cat.custom_columns()).join(newest, "host")
        own = F.col("id") == F.col("_newest")
        columns = {}
        for i in self.cat.custom_ids:
            value, ms = values.get(i) or (None, None)
            columns[f"custom_{i}"] = F.when(own, F.lit(value).cast("long"))
            columns[f"custom_{i}_time"] = F.when(own, F.lit(ms).cast("long"))
        return marked.withColumns(columns).drop("_newest")

    def _purge(self, spark: SparkSession, newest: date) -> None:
        """Samples and alerts before the kept days; numbers of a host rise with time, so no alert loses its sample."""
        for name in ("samples", "alerts"):
            if open_table(spark, self.path(name)) is not None:
                drop_old_days(spark, self.path(name), newest - timedelta(days=self.keep_days))

    def _log(self, evaluated: DataFrame) -> None:
        """Each firing sample and rule once; what a first attempt stored lies in the same days."""
        events = evaluated.select("host", "ts", F.col("id").alias("sv_report_sample_id")).join(
            alert_events(fired_long(evaluated)), ["host", "sv_report_sample_id"])
        stored = open_table(evaluated.sparkSession, self.path("alerts"))
        if stored is not None:
            keys = ["day", "host", "alert_condition_id", "sv_report_sample_id"]
            events = events.withColumn("day", F.to_date("ts")).join(stored.select(*keys), keys, "left_anti").drop("day")
        append_rows(materialize(events, "events"), self.path("alerts"), self.shards)

    def run(self, stream: DataFrame) -> None:
        """Drain what has arrived."""
        each_batch(stream, self, self.path("offsets"))

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """``samples``, ``hour``, ``day`` or ``alerts``."""
        return read_table(spark, self.path(name))
