"""Changes and silent hosts with state kept by key.

Spark keeps the state in its own store (RocksDB), a value for each key, and writes only what a batch changes; old keys go by
a time to live. Timers tell of a host that fell silent though nothing arrives any more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from gaugeweave.catalog import MetricCatalog
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.delta import BLOCK, block_of, changes_of
from gaugeweave.streaming.run import WATERMARK, event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
DAY_MS = 86_400_000


@contextmanager
def keyed_state(spark, idle_batches: bool = True):
    """Streams started inside keep their state in RocksDB, as state by key requires.

    State with a clock asks for one batch after the other, though nothing arrives; a stream that is to end when it has read
    what is there (``keyed_deltas`` with the trigger ``availableNow``) is started without ``idle_batches``.
    """
    wanted = {PROVIDER: ROCKS, IDLE: str(idle_batches).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Pairing(StatefulProcessor):
    """Each row with the values of the one numbered one lower; the newest row of a key is its state."""

    def __init__(self, values: Sequence[str], carried: StructType, paired: StructType, ttl_ms: int):
        self.values, self.carried, self.ttl_ms = list(values), carried, ttl_ms
        self.paired = Row(*paired.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.carried, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, out = self.last.get() if self.last.exists() else None, []
        for row in sorted(rows, key=lambda r: r["id"]):
            now = tuple(row[c] for c in ("id", *self.values))
            if before is not None and row["_own"] and before[0] == now[0] - 1:
                out.append(self.paired(*row[:-1], *before[1:]))
            if before is None or now[0] >= before[0]:
                before = now
        self.last.update(before)
        return iter(out)


def keyed_deltas(samples: DataFrame, cat: MetricCatalog, metrics: Sequence[str], params: Sequence[str] = (),
                 block: int = BLOCK, ttl_ms: int = DAY_MS) -> DataFrame:
    """Changes of a stream of samples in order of their number; start it inside ``keyed_state``.

    The key is the host and a block of sample numbers, and the last row of a block goes to the next one too, where it only
    is a predecessor. So the backlog of a busy host spreads over tasks, and each state is one row. The state of a block
    is dropped ``ttl_ms`` after it last changed: of blocks that are full, and of hosts that fell silent, whose next
    sample then counts as the first. A late row gives no change (``TableDeltaStep`` takes rows in any order).
    """
    values = ["ts", *metrics]
    rows = samples.select("host", "id", "ts", *metrics, *params)
    own = block_of(F.col("id"), block)
    homes = F.when(F.pmod("id", F.lit(block)) == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    placed = rows.withColumn("_block", F.explode(homes)).withColumn("_own", F.col("_block") == own)
    types = {f.name: f.dataType for f in rows.schema.fields}
    carried = StructType([StructField(c, types[c]) for c in ("id", *values)])
    kept = [f for f in placed.schema.fields if f.name != "_own"]
    paired = StructType([StructField(f.name, f.dataType) for f in kept] + [StructField(f"prev_{c}", types[c]) for c in values])
    pairs = placed.groupBy("host", "_block").transformWithState(
        Pairing(values, carried, paired, ttl_ms), paired, "append", "processingTime")
    return changes_of(pairs, cat, metrics, params)


class Silence(StatefulProcessor):
    """The newest sample time of a host, and a timer that is moved on whenever the host speaks."""

    def __init__(self, after_ms: int, by_clock: bool, ttl_ms: int | None):
        self.after_ms, self.by_clock, self.ttl_ms = after_ms, by_clock, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(r["ts"] for r in rows)
        if self.seen.exists() and (before := self.seen.get()[0]) >= newest:
            newest = before
        self.seen.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else round(newest.timestamp() * 1000)
        self.handle.registerTimer(now + self.after_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            yield Row(host=key[0], ts_last=self.seen.get()[0])


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each host and task, so that a busy host costs no more than a quiet one."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        held = table.group_by("host").aggregate([("ts", "max")]).rename_columns(["host", "ts"]).cast(batch.schema)
    if held is not None:
        yield from held.to_batches()


def silent_hosts(samples: DataFrame, after: timedelta = timedelta(hours=1), clock: str = "event", delay: str = WATERMARK,
                 ttl_ms: int | None = None) -> DataFrame:
    """(host, ts_last) of hosts that fell silent, each once until it speaks again; start it inside ``keyed_state``.

    With the ``event`` clock a host is silent when the newest sample of all hosts, less ``delay``, is ``after`` beyond its
    own newest one. With the ``processing`` clock the time since its last sample arrived counts: it is told even if
    nothing arrives any more, provided the stream keeps running, and forgotten after ``ttl_ms``.
    """
    by_clock = clock == "processing"
    newest = event_time(samples.select("host", "ts")).mapInArrow(_newest, "host string, ts timestamp")
    newest = newest if by_clock else newest.withWatermark("ts", delay)
    told = newest.groupBy("host").transformWithState(
        Silence(int(after.total_seconds() * 1000), by_clock, ttl_ms if by_clock else None), "host string, ts_last timestamp",
        "append", "processingTime" if by_clock else "eventTime")
    return told.select("host", F.col("ts_last").cast(NTZ).alias("ts_last"))
