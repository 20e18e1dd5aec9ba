"""Changes of samples batch by batch: in order of their number, or in any order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.catalog import MetricCatalog
from gaugeweave.operators.delta import BLOCK, delta, delta_between, followers, sample_columns
from gaugeweave.operators.ingest import append_samples
from gaugeweave.operators.rollup import latest_rows
from gaugeweave.session import materialize
from gaugeweave.sources.tables import append_rows, exists, open_table
from gaugeweave.streaming.run import BatchTable


@dataclass(frozen=True)
class DeltaStep:
    """One micro-batch of samples in order: the newest sample of each host is carried to the next batch.

    The batch operator does the work, so a host with a long backlog spreads over all tasks here too,
    and stream and batch give the same rows.
    """

    cat: MetricCatalog
    metrics: Sequence[str]
    params: Sequence[str]
    carried: BatchTable
    block: int = BLOCK

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        rows = batch.select("host", "id", "ts", *self.metrics, *self.params)
        before = self.carried.of(batch.sparkSession, number - 1, rows.schema)
        known = rows.withColumn("_new", F.lit(1).cast("long")).unionByName(
            before.withColumn("_new", F.lit(0).cast("long")))
        self.carried.write(latest_rows(known.drop("_new")), number)
        changes = delta(known, self.cat, self.metrics, [*self.params, "_new"], block=self.block)
        return changes.where("_new = 1").drop("_new")


@dataclass(frozen=True)
class TableDeltaStep:
    """One micro-batch of samples in any order, with the sample table as memory.

    A pair of neighbours gives its change once, with the batch that brings the second of them, whichever that is: a
    late sample gets its own change and gives its successor one. The new samples of a batch are noted before they are
    stored, so a batch that is repeated after a failure gives the same rows. Predecessors are looked up in the days of
    the batch and ``lookback_days`` before; only for those that have none there, in the rest of the table.
    """

    cat: MetricCatalog
    metrics: Sequence[str]
    params: Sequence[str]
    samples_path: str
    noted: BatchTable
    lookback_days: int = 1
    shards: int = 16
    step: int | str = 1

    def __call__(self, batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        rows = materialize(batch.select(*sample_columns(self.metrics, self.params, self.step)), "arrived")
        stored = self._days_of(rows, open_table(spark, self.samples_path))
        fresh = self._noted(rows, stored, number)
        append_rows(fresh if stored is None else fresh.join(stored.select("host", "id"), ["host", "id"], "left_anti"),
                    self.samples_path, self.shards)
        first, last = fresh.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
        table = open_table(spark, self.samples_path)
        if first is None or table is None:
            return self._changes(fresh, fresh)
        near = table.where(F.col("day").between(F.date_sub(F.lit(first), self.lookback_days), F.lit(last)))
        changes = materialize(self._changes(fresh, near), "near-changes")
        alone = materialize(fresh.join(changes.select("host", "id"), ["host", "id"], "left_anti"), "unpaired")
        if not alone.isEmpty():
            older = table.where(F.col("day") < F.date_sub(F.lit(first), self.lookback_days))
            changes = changes.unionByName(self._changes(alone, older))
        keys = fresh.select("host", "id")
        after = followers(table.where(F.col("day") >= F.lit(first)), keys, self.step)
        return changes.unionByName(self._changes(after.join(keys, ["host", "id"], "left_anti"), fresh))

    def _days_of(self, rows: DataFrame, stored: DataFrame | None) -> DataFrame | None:
        """The stored rows of the batch's days: a second of the batch can only be stored there, and so can its number,
        which a host gives once."""
        first, last = rows.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
        return stored if stored is None or first is None else stored.where(F.col("day").between(F.lit(first), F.lit(last)))

    def _noted(self, rows: DataFrame, stored: DataFrame | None, number: int) -> DataFrame:
        """The new samples of this batch, as they were when it was first tried."""
        spark, tagged = rows.sparkSession, rows.withColumn("_batch", F.lit(number).cast("long"))
        if exists(spark, self.noted.folder(number)):
            known = self.noted.of(spark, number, tagged.schema).where(F.col("_batch") == number)
            if not known.isEmpty():
                return known.drop("_batch")
        return self.noted.write(materialize(append_samples(tagged, stored), "fresh"), number).drop("_batch")

    def _changes(self, current: DataFrame, earlier: DataFrame) -> DataFrame:
        return delta_between(current, earlier, self.cat, self.metrics, self.params, self.step)
