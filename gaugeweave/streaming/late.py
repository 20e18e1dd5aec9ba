"""Windows of a stream that lose no row: what comes behind the event clock is kept aside and merged afterwards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.catalog import SAMPLE, Grain
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.rollup import bucket_end, bucket_start, rollup
from gaugeweave.operators.states import states
from gaugeweave.session import materialize
from gaugeweave.streaming.run import BatchTable

CLOCK_SCHEMA = "number long, ts timestamp_ntz"


@dataclass(frozen=True)
class Parts:
    """Partial aggregates of a window: how rows make them, and how each column of two parts is put together."""

    grain: Grain
    make: Callable[[DataFrame], DataFrame]
    folds: Mapping[str, Callable]

    def merged(self, parts: DataFrame) -> DataFrame:
        """One part for each host and window; columns keep their types, so parts can be merged again."""
        aggs = [fold(c).cast(parts.schema[c].dataType).alias(c) for c, fold in self.folds.items()]
        return parts.groupBy("host", "ts").agg(*aggs)


def rollup_parts(grain: Grain, metrics: Sequence[str], params: Sequence[str] = ()) -> Parts:
    """Rollup rows are their own parts: lowest number, summed seconds and changes, highest values."""
    folds = {"id": F.min, "end_ts": F.max, "ts_diff_seconds": F.sum, **dict.fromkeys([*metrics, *params], F.max),
             **{f"{m}_diff": F.sum for m in metrics}}
    return Parts(grain, lambda rows: rollup(rows, grain, metrics, params), folds)


def average_parts(metrics: Mapping[str, int]) -> Parts:
    """Sums in whole units and counts of ten minutes, for ``operators.states.averages``."""
    folds = {"count_rows": F.sum, "id": F.max}
    for m in metrics:
        folds |= {f"{m}_units": F.sum, f"{m}_count": F.sum}
    return Parts(SAMPLE, lambda rows: states(rows, metrics), folds)


@dataclass(frozen=True)
class WindowStep:
    """One micro-batch: windows are closed, each once, when the event clock has passed their end by the delay.

    The clock is the newest row of all batches before. Rows of windows that it has closed are written to the side table
    ``late``, as they came. Between batches only the parts of open windows are carried, one row for each host and
    window. A batch that is repeated starts from the same clock and parts and overwrites its own folders; the clock is
    written last.
    """

    parts: Parts
    clock: BatchTable
    opened: BatchTable
    closed: BatchTable
    late: BatchTable
    delay_seconds: int = 600

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch, "arrived")
        told = self.clock.of(spark, number - 1, CLOCK_SCHEMA).first()
        before = told["ts"] if told else None
        newest = rows.agg(F.max("ts").cast(NTZ)).first()[0]
        now = max((t for t in (before, newest) if t is not None), default=None)

        start = bucket_start(F.col("ts"), self.parts.grain)
        behind = self._passed(start, before)
        self.late.write(rows.where(behind), number)
        fresh = self.parts.make(rows.where(~behind))
        carried = self.opened.of(spark, number - 1, fresh.schema)
        merged = materialize(self.parts.merged(carried.unionByName(fresh)).select(*fresh.columns), "windows")
        done = self._passed(F.col("ts"), now)
        self.closed.write(merged.where(done), number)
        self.opened.write(merged.where(~done), number)
        self.clock.write(spark.createDataFrame([(number, now)], CLOCK_SCHEMA), number)

    def _passed(self, start, clock):
        """Whether the window that begins at ``start`` had ended before the clock less the delay."""
        limit = F.lit(clock).cast(NTZ) - F.make_dt_interval(secs=F.lit(self.delay_seconds))
        return F.coalesce(bucket_end(start, self.parts.grain).cast(NTZ) <= limit, F.lit(False))

    def settled(self, spark: SparkSession) -> DataFrame:
        """The closed windows with the late rows that belong to them; a window that only late rows fill is among them."""
        return self._merged(self.closed.all(spark), self.parts.make(self.late.all(spark)))

    def every(self, spark: SparkSession) -> DataFrame:
        """All windows, those still open after the last batch included: the same as over all rows at once."""
        number = self.clock.all(spark).agg(F.max("number")).first()[0]
        settled = self.settled(spark)
        return self._merged(settled, self.opened.of(spark, number, settled.schema))

    def _merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        return self.parts.merged(one.unionByName(other)).select(*one.columns)
