"""Reading and writing sample tables, rollup tables and dimensions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from gaugeweave.catalog import Grain
from gaugeweave.operators.rollup import rollup


def scan_samples(samples: DataFrame, metrics: Sequence[str], since: Column | None = None,
                 until: Column | None = None) -> DataFrame:
    """The wanted metrics in ``[since, until)``; both prunings reach the file scan.

    A table that still has its ``day`` folders as a column is filtered by day as well, so other folders are not read.
    """
    return in_span(samples, since, until).select("host", "id", "ts", *metrics)


def in_span(rows: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows in ``[since, until)``, with the days that this implies."""
    by_day = "day" in rows.columns
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
        rows = rows.where(F.col("day") >= F.to_date(since)) if by_day else rows
    if until is not None:
        rows = rows.where(F.col("ts") < until)
        rows = rows.where(F.col("day") <= F.to_date(until)) if by_day else rows
    return rows


def union_hosts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One table from one per host; columns a host lacks are NULL."""
    tagged = [t.select(F.lit(h).alias("host"), "*") for h, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


HOST_FOLDER = "host="


def read_hosts(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """One table from a folder for each host, in a single scan with a declared schema.

    Hosts are found by listing: ``host`` is the name of the folder right under ``root`` that a file lies in, with or
    without ``host=`` before it. Columns that a host's files lack are NULL.
    """
    declared = spark.createDataFrame([], schema).schema
    fields = [f for f in declared.fields if f.name != "host"]
    files = spark.read.schema(StructType(fields)).option("recursiveFileLookup", "true").parquet(root)
    # The path of a file is a URI: what a folder name may not hold there is escaped.
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.substring_index(F.substring_index(path, f"{base}/", -1), "/", 1)
    host = F.when(F.startswith(below, F.lit(HOST_FOLDER)), F.substring(below, len(HOST_FOLDER) + 1, 1 << 20)).otherwise(below)
    return files.select(host.alias("host"), *[f.name for f in fields])


def enabled(dimension: DataFrame) -> DataFrame:
    """Rows of a registry that are switched on."""
    return dimension.where(F.col("enabled"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


# Rows of a folder are gathered before they are written, so that it gets few files; Spark splits a folder that is too
# large for one task and merges small ones. Names with an underscore are no data to any reader.
FOLDERS = ("day", "shard")
WIDE = DecimalType(20, 0)
SCHEMA, JOURNAL, COMPLETE = "_schema", "_upsert", "_complete"


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumns({"day": F.to_date("ts"), "shard": shard_of(F.col("host"), shards)})


def append_rows(rows: DataFrame, path: str, shards: int = 16) -> None:
    """Append samples to a table laid out by day and host shard."""
    append_placed(_placed(rows, shards), path, FOLDERS)


def append_placed(placed: DataFrame, path: str, folders: Sequence[str]) -> None:
    """Append rows that carry their folder columns, and note new columns in the table's schema."""
    placed = _note_schema(placed, path)
    placed.hint("rebalance", *folders).write.mode("append").partitionBy(*folders).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the table has a data file or folder; folders and files that readers skip do not count."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return False
    return any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(place))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and how to name places in it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, make = _files(spark, path)
    if not files.exists(make(path)):
        return None
    stream = files.open(make(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file beside the data, such as a marker that something is complete."""
    files, make = _files(spark, path)
    stream = files.create(make(path), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def is_marked(spark: SparkSession, path: str) -> bool:
    files, make = _files(spark, path)
    return files.exists(make(path))


def stored_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema that a table records: all columns ever written, with their types, in the order they appeared."""
    text = _read_text(spark, f"{path.rstrip('/')}/{SCHEMA}")
    return None if text is None else StructType.fromJson(json.loads(text))


def _note_schema(rows: DataFrame, path: str) -> DataFrame:
    """Add the columns of new rows to the recorded schema, and give the rows its types.

    A column keeps the type it was first written with, but a long becomes a number of twenty digits when such ones come;
    files with longs are read as such from then on.
    """
    spark = rows.sparkSession
    known = stored_schema(spark, path)
    if known is None:  # a table written without a record is read once with merged footers
        known = spark.read.option("mergeSchema", "true").parquet(path).schema if exists(spark, path) else StructType()
        begun = False
    else:
        begun = True
    types = {f.name: f.dataType for f in known.fields}
    for f in rows.schema.fields:
        stored = types.setdefault(f.name, f.dataType)
        if (stored, f.dataType) == (LongType(), WIDE):
            types[f.name] = WIDE
        elif stored != f.dataType and (stored, f.dataType) != (WIDE, LongType()):
            raise ValueError(f"{path}: {f.name} is stored as {stored.simpleString()}, not {f.dataType.simpleString()}")
    grown = StructType([StructField(n, t) for n, t in types.items()])
    if not begun or types != {f.name: f.dataType for f in known.fields}:
        write_text(spark, f"{path.rstrip('/')}/{SCHEMA}", grown.json())
    return rows.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in rows.columns])


def open_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """A stored table with its ``day`` and ``shard`` folders as columns, or None if nothing is stored yet.

    Without a declared ``schema`` the one that the table records is used, so a metric that appeared later is read, and
    NULL in older files, and no footer is opened. A table without a record has the columns of all files merged. Any
    error but a missing table is raised.
    """
    if not exists(spark, path):
        return None
    schema = schema or stored_schema(spark, path)
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The columns of a stored table without those of its folders."""
    table = open_table(spark, path, schema)
    if table is None:
        raise FileNotFoundError(path)
    return table.drop("day", "shard")


def _overwrite_folders(placed: DataFrame, path: str, folders: Sequence[str]) -> None:
    placed.hint("rebalance", *folders).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*folders).parquet(path)


def _finish_upsert(spark: SparkSession, path: str, folders: Sequence[str]) -> None:
    """Repeat an upsert whose journal is complete; a journal that was cut short says nothing and goes."""
    journal = f"{path.rstrip('/')}/{JOURNAL}"
    files, make = _files(spark, journal)
    if files.exists(make(f"{journal}/{COMPLETE}")):
        _overwrite_folders(spark.read.parquet(journal), path, folders)
    files.delete(make(journal), True)


def recover(spark: SparkSession, path: str, folders: Sequence[str] = FOLDERS) -> None:
    """Finish an upsert that a lost job left complete; a step that reads a table to write it calls this before it reads."""
    _finish_upsert(spark, path, folders)


def replace_rows(fresh: DataFrame, touched: DataFrame, path: str, keys: Sequence[str], folders: Sequence[str]) -> None:
    """Replace the stored rows whose ``keys`` are in ``touched`` by the fresh ones; both carry their folder columns.

    Only folders with a touched key are read and rewritten. Their new content is first written to a journal beside them
    and marked complete; a job that dies while folders are replaced loses nothing, the next call repeats it. Running it
    again with the same rows leaves the same table. One job at a time may write a table. A folder must not become empty.
    """
    spark = fresh.sparkSession
    _finish_upsert(spark, path, folders)
    fresh = _note_schema(fresh, path)
    current = open_table(spark, path)
    if current is not None:
        # Folder columns as join keys: the scan skips every folder that is not touched.
        inside = current.join(touched.select(*folders).distinct(), list(folders), "left_semi")
        kept = inside.join(touched.select(*keys), list(keys), "left_anti")
        fresh = kept.unionByName(fresh, allowMissingColumns=True)
    journal = f"{path.rstrip('/')}/{JOURNAL}"
    fresh.write.mode("overwrite").parquet(journal)
    write_text(spark, f"{journal}/{COMPLETE}")
    _finish_upsert(spark, path, folders)


def upsert_buckets(fresh: DataFrame, path: str, shards: int = 16) -> None:
    """Replace rollup rows of equal (host, ts) and keep the others, with all their columns; see ``replace_rows``."""
    placed = _placed(fresh, shards)
    replace_rows(placed, placed.select("host", "ts", *FOLDERS), path, ["host", "ts"], FOLDERS)


def rebuild_buckets(deltas: DataFrame, path: str, grain: Grain, metrics: Sequence[str], params: Sequence[str] = (),
                    shards: int = 16) -> None:
    """Compute a whole rollup table from deltas again; folders without a bucket any more go."""
    rows = _placed(rollup(deltas, grain, metrics, params), shards)
    rows = _note_schema(rows, path)
    rows.hint("rebalance", *FOLDERS).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day", "shard").parquet(path)


def drop_old_days(spark: SparkSession, path: str, first: date) -> list[str]:
    """Delete the ``day`` folders before ``first`` and return their names; nothing is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for folder in files.listStatus(place):
        name = folder.getPath().getName()
        if name.startswith("day=") and name[4:] < first.isoformat():
            files.delete(folder.getPath(), True)
            gone.append(name)
    return sorted(gone)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)
