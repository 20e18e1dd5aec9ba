"""One collection run as a micro-batch: store, roll up, evaluate, notify."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gaugeweave.catalog import DAY, HOUR, MetricCatalog
from gaugeweave.operators.alerts import Condition, evaluate_wide
from gaugeweave.operators.delta import rates
from gaugeweave.operators.report import inputs_of, report
from gaugeweave.sources.tables import read_table
from gaugeweave.streaming.alerts import EpisodeStep
from gaugeweave.streaming.deltas import DeltaStep
from gaugeweave.streaming.rollups import RefreshStep
from gaugeweave.streaming.run import BatchTable, each_batch


@dataclass(frozen=True)
class Checkpoint:
    """Tables under one shared root and the steps a batch of new samples goes through.

    Rollups take late samples; alerts look at samples in order of their number, as they arrive.
    """

    root: str
    cat: MetricCatalog
    metrics: Sequence[str]
    params: Sequence[str]
    watched: Sequence[str] = ()
    conditions: Sequence[Condition] = ()
    host_facts: DataFrame | None = None
    shards: int = 16
    _steps: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self):
        needs = inputs_of(self.watched, self.cat)
        self._steps["refresh"] = RefreshStep(
            self.cat, self.metrics, self.params, self.path("samples"),
            {HOUR: self.path("hour"), DAY: self.path("day")}, shards=self.shards)
        self._steps["delta"] = DeltaStep(
            self.cat, needs.metrics, needs.params, BatchTable(self.path("carried"), slots=2))
        self._steps["episodes"] = EpisodeStep(
            BatchTable(self.path("pending"), slots=2), BatchTable(self.path("resolved")),
            conditions=self.conditions, notices=BatchTable(self.path("notices")))

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def __call__(self, batch: DataFrame, number: int) -> None:
        # Several steps read the batch; without this each would read its source again.
        held = batch.persist()
        try:
            self._steps["refresh"](held, number)
            if self.conditions:
                self._steps["episodes"](self._evaluated(held, number), number)
        finally:
            held.unpersist()

    def _evaluated(self, batch: DataFrame, number: int) -> DataFrame:
        needs = inputs_of(self.watched, self.cat)
        deltas = self._steps["delta"](batch, number)
        rows = report(rates(deltas, needs.rates), self.watched, self.cat)
        return evaluate_wide(rows, self.conditions, self.host_facts)

    def run(self, stream: DataFrame) -> None:
        """Drain what has arrived."""
        each_batch(stream, self, self.path("offsets"))

    def samples(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.path("samples"))

    def hours(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.path("hour"))

    def days(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.path("day"))

    def notices(self, spark: SparkSession) -> DataFrame:
        return BatchTable(self.path("notices")).all(spark)
