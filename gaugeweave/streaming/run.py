"""Starting streams and keeping per-batch state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeweave.session import scratch_dir
from gaugeweave.sources.tables import COMPLETE, is_marked, write_text

WATERMARK = "10 minutes"


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None,
               pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def event_time(rows: DataFrame) -> DataFrame:
    """``ts`` as an instant, as watermarks require."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into a parquet table with exactly-once files."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Drain what is available, calling ``step(batch, number)``; a repeated number must give the same result."""
    stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


@dataclass(frozen=True)
class BatchTable:
    """A folder with one sub-folder per micro-batch.

    Batch N reads the state of N-1 and overwrites its own folder, so a batch that is run again after
    a failure starts from the same state and leaves the same rows. With ``slots`` the folders are
    reused in turn: two are enough for state, where only the batch before is ever read.
    """

    path: str
    slots: int | None = None

    def folder(self, number: int) -> str:
        return f"{self.path}/batch={number % self.slots if self.slots else number}"

    def write(self, rows: DataFrame, number: int) -> DataFrame:
        target = self.folder(number)
        rows.write.mode("overwrite").parquet(target)
        return rows.sparkSession.read.schema(rows.schema).parquet(target)

    def write_once(self, rows: DataFrame, number: int) -> None:
        """Write a batch that must stay as it was first written, and mark it complete."""
        self.write(rows, number)
        write_text(rows.sparkSession, f"{self.folder(number)}/{COMPLETE}")

    def has(self, spark: SparkSession, number: int) -> bool:
        """Whether ``write_once`` has completed this batch."""
        return is_marked(spark, f"{self.folder(number)}/{COMPLETE}")

    def of(self, spark: SparkSession, number: int, schema: StructType | str) -> DataFrame:
        """Rows of a batch; empty before the first one."""
        if number < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.folder(number))

    def all(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("batch")


def output_table(spark: SparkSession, label: str) -> BatchTable:
    """All batches are kept."""
    return BatchTable(scratch_dir(spark, label))


def state_table(spark: SparkSession, label: str) -> BatchTable:
    """Only the state of the last two batches is kept."""
    return BatchTable(scratch_dir(spark, label), slots=2)
