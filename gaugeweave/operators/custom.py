"""Registered scalar queries and their place in the sample row."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.catalog import MetricCatalog
from gaugeweave.operators.ingest import align_schema

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CustomQuery:
    custom_query_id: int
    query_eval: str
    description: str = ""
    chart_type: str = "value"
    chart_order: int = 0
    enabled: bool = True


def run_one(spark: SparkSession, query: CustomQuery) -> tuple[int | None, int] | None:
    """Value and milliseconds of a query, or None when it is not one row of one whole number.

    The query itself runs on the cluster; two rows are enough to see that there is exactly one.
    """
    began = time.monotonic()
    try:
        frame = spark.sql(query.query_eval)
        rows = frame.take(2) if len(frame.columns) == 1 else []
        if len(rows) != 1:
            raise ValueError("not a single value")
        value = None if rows[0][0] is None else int(rows[0][0])
    except (ValueError, TypeError, PySparkException) as error:
        log.warning("custom query %d skipped: %s", query.custom_query_id, str(error).splitlines()[0])
        return None
    return value, int(1000 * (time.monotonic() - began))


def run_pool(spark: SparkSession, queries: Sequence[CustomQuery], workers: int = 4,
             seconds: float = 60.0) -> dict[int, tuple[int | None, int]]:
    """Value and milliseconds by id of the enabled queries that worked, run at the same time by a bounded pool.

    Each query has its own limit of ``seconds``, counted from its start: its jobs are cancelled by their tag. One that is
    too slow or fails is left out and does not hold up the others.
    """
    context = spark.sparkContext

    def work(query: CustomQuery) -> tuple[int | None, int] | None:
        tag = f"custom-{query.custom_query_id}-{uuid.uuid4().hex}"
        late = threading.Timer(seconds, context.cancelJobsWithTag, [tag])
        context.addJobTag(tag)
        late.start()
        try:
            return run_one(spark, query)
        except Exception as error:  # noqa: BLE001 - a cancelled job raises whatever the gateway gives
            log.warning("custom query %d skipped: %s", query.custom_query_id, str(error).splitlines()[0])
            return None
        finally:
            late.cancel()
            context.removeJobTag(tag)

    chosen = [q for q in queries if q.enabled]
    with ThreadPoolExecutor(workers) as pool:
        outcomes = zip(chosen, pool.map(work, chosen))
        return {q.custom_query_id: o for q, o in outcomes if o is not None}


def run_custom(spark: SparkSession, queries: Sequence[CustomQuery]) -> DataFrame:
    """(custom_query_id, value, time_ms) of the enabled queries that worked."""
    rows = [(i, *outcome) for i, outcome in run_pool(spark, queries).items()]
    return spark.createDataFrame(rows, "custom_query_id int, value long, time_ms long")


def attach_custom(samples: DataFrame, results: DataFrame, cat: MetricCatalog) -> DataFrame:
    """Put results (host, id, custom_query_id, value, time_ms) into the sample rows they belong to.

    Samples of other numbers keep their values; queries without a result stay NULL.
    """
    picked = []
    for i in cat.custom_ids:
        of = F.col("custom_query_id") == i
        picked += [
            F.max(F.when(of, F.col("value"))).alias(f"_new_custom_{i}"),
            F.max(F.when(of, F.col("time_ms"))).alias(f"_new_custom_{i}_time"),
        ]
    wide = results.groupBy("host", "id").agg(*picked, F.lit(True).alias("_hit"))
    columns = cat.custom_columns()
    aligned = align_schema(samples, cat, columns)
    joined = aligned.join(wide, ["host", "id"], "left")
    # A measured NULL replaces the old value as well; its time tells that the query ran.
    filled = {}
    for i in cat.custom_ids:
        ran = F.col(f"_new_custom_{i}_time").isNotNull()
        for c in (f"custom_{i}", f"custom_{i}_time"):
            filled[c] = F.when(ran, F.col(f"_new_{c}")).otherwise(F.col(c))
    return joined.withColumns(filled).drop("_hit", *[f"_new_{c}" for c in columns])
