"""Reading columns safely, passing rows through Arrow functions, bitmaps of a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_WORDS = 1 << 18  # 2^24 bits, 2 MB whatever the input
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns under the library's own names; all other columns are left out, so none can clash."""
    return df.select([df[f"`{source}`"].alias(name) for name, source in wanted.items()])


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at 4 MB too, not only at 10,000 rows of any length, unless the session has its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def rows(df: DataFrame, work: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``work(iterator of Arrow batches)`` yields lists of result rows; they are passed on in batches.

    Nothing is held beyond one input batch and the rows that ``work`` has yielded for it.
    """
    target = to_arrow(df.sparkSession, schema)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for result in work(batches):
            for start in range(0, len(result), 4096):
                part = result[start : start + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(zip(*part), target)], schema=target
                )

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], schema: str, size: int = 256) -> DataFrame:
    """All rows and columns with those of ``schema``, which ``work`` computes for at most ``size`` rows at a time.

    Existing columns of these names are replaced.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    kept = df.drop(*added.names)
    whole = StructType(kept.schema.fields + added.fields)
    target = to_arrow(df.sparkSession, schema)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                fields = [part.schema.field(i) for i in range(part.num_columns)] + list(target)
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], schema=pa.schema(fields))

    return kept.mapInArrow(run, whole)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is divisible by five (a null id never is)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fold(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def bitmap(ids: DataFrame) -> np.ndarray:
    """Which hashes of the single column of ids occur; see ``marks``."""
    (name,) = ids.columns
    return marks(ids.select(bitmap_position(F.col(name)).alias("at")))


def marks(places: DataFrame) -> np.ndarray:
    """The places ``at`` (0 to 2^24 - 1) that occur, as 2^18 words of 64 bits.

    The size does not depend on the number of rows; with very many rows every bit is set and the filter lets all
    pass. It only saves moving rows that a later exact join would discard.
    """
    words = _bits(places).toArrow()
    out = np.zeros(BITMAP_WORDS, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _bits(places: DataFrame) -> DataFrame:
    words = places.selectExpr("CAST(shiftright(at, 6) AS INT) AS word", "shiftleft(1L, CAST(at & 63 AS INT)) AS bits")
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the single column of ``gone``; a null key stays.

    Only rows that a bitmap of ``gone`` lets pass move to be compared, and most of those are dropped. The others, and
    so their texts, stay in their tasks; they would all move once ``gone`` is too large for a broadcast.
    """
    (name,) = gone.columns
    gone = gone.select(F.col(name).alias("__gone"))
    # The bitmap as a table of 2^18 rows at most.
    bits = _bits(gone.select(bitmap_position(F.col("__gone")).alias("at"))).toDF("__word", "__bits")
    own = [F.col(f"`{c}`") for c in df.columns]
    marked = df.withColumns({"__key": key, "__at": bitmap_position(key)})
    marked = marked.join(F.broadcast(bits), F.expr("CAST(shiftright(__at, 6) AS INT) = __word"), "left")
    hit = F.expr("coalesce(shiftrightunsigned(__bits, CAST(__at & 63 AS INT)) & 1 = 1, false)")
    compared = marked.where(hit).join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    return marked.where(~hit).select(own).union(compared.select(own))


def bitmap_position(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP_WORDS * 64))


def in_bitmap(words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    p = positions.astype(np.uint64)
    return (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
