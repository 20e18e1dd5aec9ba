"""Alert episodes of rows that arrive in any order.

A late row may split, shorten, join or begin an episode. Evaluated rows are kept in a table; the runs inside each block
of sample numbers are kept in another. A batch computes only the runs of the blocks it touches again, by the operator
that batch evaluation uses, and chains them with the edge runs of their hosts. So the episodes equal those of all rows
at once, whatever the order of arrival.

Notices are a ledger: an episode that is in error is told once, and once more when it has ended. If later rows take
away what a notice said (its episode begins elsewhere, or is not long enough any more), the notice is withdrawn. What is
told and not withdrawn is what all rows at once would give, each once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.functions.numeric import div
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.alerts import Condition, at_edge, block_runs, chained, conditions_frame, message, with_conditions
from gaugeweave.operators.delta import block_of
from gaugeweave.session import materialize
from gaugeweave.sources.tables import append_placed, open_table, replace_rows, shard_of
from gaugeweave.streaming.run import BatchTable

FOLDERS = ("span", "shard")
SPAN = 64  # blocks of one folder
KEYS = ["host", "_block"]
NOTICE = ["host", "alert_condition_id", "start_id", "resolved"]
EPISODE_SCHEMA = (
    "host string, alert_condition_id int, start_id long, end_id long, ts_start timestamp_ntz, ts_end timestamp_ntz, fires long, "
    "closed boolean"
)


@dataclass(frozen=True)
class RepairStep:
    """One micro-batch of evaluated rows (wide form), in any order; a repeated batch changes nothing.

    ``block`` bounds what a late row costs: the rows of its block are read again, and three rows for each block and rule
    of its host are chained. The folders of both tables follow the blocks, so other parts of the history are not opened.
    """

    evaluated_path: str
    runs_path: str
    conditions: Sequence[Condition] = ()
    notices: BatchTable | None = None
    block: int = 16_384
    shards: int = 16

    def __call__(self, evaluated: DataFrame, number: int) -> None:
        spark = evaluated.sparkSession
        rows = materialize(self._placed(evaluated.withColumn("_block", block_of(F.col("id"), self.block))), "evaluated")
        touched = materialize(rows.select(*KEYS, *FOLDERS).distinct(), "touched")
        if touched.isEmpty():
            return
        stored = open_table(spark, self.evaluated_path)
        fresh = rows.dropDuplicates(["host", "id"])
        if stored is not None:
            inside = stored.join(touched, [*KEYS, *FOLDERS], "left_semi")
            fresh = fresh.join(inside.select("host", "id"), ["host", "id"], "left_anti")
        append_placed(fresh, self.evaluated_path, FOLDERS)
        inside = open_table(spark, self.evaluated_path).join(touched, [*KEYS, *FOLDERS], "left_semi")
        runs = materialize(self._placed(block_runs(inside.drop(*FOLDERS, "_block"), self.block)), "runs")
        if self.notices is not None and not self.notices.has(spark, number):
            self._tell(touched, runs, number)
        replace_rows(runs, touched, self.runs_path, KEYS, FOLDERS)

    def episodes(self, spark: SparkSession) -> DataFrame:
        """All episodes so far, with ``closed``."""
        runs = open_table(spark, self.runs_path)
        return spark.createDataFrame([], EPISODE_SCHEMA) if runs is None else chained(runs)

    def standing_notices(self, spark: SparkSession) -> DataFrame:
        """What was told and not withdrawn, with ``times``, which is one."""
        told = self.notices.all(spark).withColumn("_n", F.when(F.col("withdrawn"), -1).otherwise(1))
        return told.groupBy(*NOTICE).agg(F.sum("_n").alias("times")).where("times <> 0")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"span": div(F.col("_block"), F.lit(SPAN)), "shard": shard_of(F.col("host"), self.shards)})

    def _tell(self, touched: DataFrame, runs: DataFrame, number: int) -> None:
        """The difference between what the batch finds and what it leaves. Written before the runs change, so a repeated
        batch finds either its own notices or the same runs."""
        spark = runs.sparkSession
        before = open_table(spark, self.runs_path)
        after = runs if before is None else before.join(touched, [*KEYS, *FOLDERS], "left_anti").unionByName(runs)
        now = materialize(self._due(self._around(after, touched)), "due")
        if before is None:
            told, gone = now, now.limit(0)
        else:
            was = materialize(self._due(self._around(before, touched)), "due-before")
            told, gone = now.join(was, NOTICE, "left_anti"), was.join(now, NOTICE, "left_anti")
        ledger = told.withColumn("withdrawn", F.lit(False)).unionByName(gone.withColumn("withdrawn", F.lit(True)))
        self.notices.write_once(ledger, number)

    def _around(self, runs: DataFrame, touched: DataFrame) -> DataFrame:
        """The episodes a batch may have changed: inner runs of its blocks, and chains of its hosts."""
        edges = runs.where(at_edge()).join(touched.select("host").distinct(), "host", "left_semi")
        inner = runs.where(~at_edge()).join(touched, [*KEYS, *FOLDERS], "left_semi")
        return chained(edges.unionByName(inner, allowMissingColumns=True))

    def _due(self, found: DataFrame) -> DataFrame:
        """One row for an episode in error, one more when it has ended."""
        shaped = found.withColumn("resolved", F.explode(F.when(F.col("closed"), F.array(F.lit(False), F.lit(True))).otherwise(
            F.array(F.lit(False))))).withColumn("ts_notified", F.lit(None).cast(NTZ))
        shaped = shaped.withColumnRenamed("start_id", "sv_report_sample_id_start")
        view = with_conditions(shaped, conditions_frame(found.sparkSession, self.conditions)).where("in_error")
        view = view.withColumn("message_item", message())
        return view.withColumnRenamed("sv_report_sample_id_start", "start_id").select(*NOTICE, "elapsed_minutes", "message_item")
