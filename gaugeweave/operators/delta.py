"""Adjacent samples of a host: changes, rates and parameter changes.

A host is never handled as one group. Sample numbers are cut into blocks and the window runs per
``(host, block)``; the last rows of a block are also sent to the next one, where they serve only as
predecessors. One shuffle, bounded groups, and a host with a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.catalog import MetricCatalog
from gaugeweave.functions.numeric import div, rate_text
from gaugeweave.functions.timefn import NTZ
from gaugeweave.session import materialize

BLOCK = 65_536


def block_of(sample_id: Column, block: int) -> Column:
    return div(sample_id - F.pmod(sample_id, F.lit(block)), F.lit(block))


def latest(samples: DataFrame) -> DataFrame:
    """Newest sample number and time of each host."""
    return samples.groupBy("host").agg(F.max("id").alias("id_latest"), F.max("ts").alias("ts_latest"))


def uniform_step(samples: DataFrame, step_col: str) -> int | None:
    """The one numbering step all samples use, or None when steps differ. Reads a single column."""
    step = F.greatest(F.lit(1), F.coalesce(F.col(step_col), F.lit(1)))
    low, high = samples.agg(F.min(step), F.max(step)).first()
    return int(low) if low is not None and low == high else None


def number_before(step: int | str = 1) -> Column:
    """Number of the sample a row is compared with: ``step`` lower, or as its own step column says (1 at least)."""
    if isinstance(step, str):
        return F.col("id") - F.greatest(F.lit(1), F.coalesce(F.col(step), F.lit(1)))
    return F.col("id") - step


def _in_blocks(rows: DataFrame, step: int, block: int) -> DataFrame:
    own = F.col("_block")
    tail = F.pmod(F.col("id"), F.lit(block)) >= block - step
    homes = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    placed = rows.withColumn("_block", block_of(F.col("id"), block))
    return placed.withColumn("_home", F.explode(homes))


def adjacent(samples: DataFrame, columns: Sequence[str], step: int | str = 1, block: int = BLOCK) -> DataFrame:
    """Each sample beside the one numbered ``step`` lower; samples without it are left out.

    Adds ``prev_ts`` and ``prev_<column>``. A constant step is one windowed shuffle. A step column
    (per-row numbering step) is matched exactly by an equi-join on ``(host, number)``, which spreads
    evenly as well because the number is part of the key.
    """
    columns = list(columns)
    if isinstance(step, str):
        before = samples.select(
            F.col("host"),
            F.col("id").alias("_before"),
            F.col("ts").alias("prev_ts"),
            *[F.col(c).alias(f"prev_{c}") for c in columns],
        )
        return samples.withColumn("_before", number_before(step)).join(before, ["host", "_before"]).drop("_before")
    block = max(block, step)
    by = ["host", "_home"] if step == 1 else ["host", "_home", "_lane"]
    rows = _in_blocks(samples, step, block)
    if step > 1:
        rows = rows.withColumn("_lane", F.pmod(F.col("id"), F.lit(step)))
    over = f"OVER (PARTITION BY {', '.join(by)} ORDER BY id)"
    rows = rows.selectExpr(
        "*",
        f"lag(id) {over} AS _prev_id",
        f"lag(ts) {over} AS prev_ts",
        *[f"lag(`{c}`) {over} AS `prev_{c}`" for c in columns],
    )
    kept = rows.where((F.col("_prev_id") == F.col("id") - step) & (F.col("_home") == F.col("_block")))
    return kept.drop("_home", "_block", "_prev_id", "_lane")


def change(name: str, gauge: bool) -> str:
    """Difference to the previous sample; a counter that fell was reset and counts from zero."""
    now, before = f"`{name}`", f"`prev_{name}`"
    if gauge:
        return f"{now} - {before}"
    return f"CASE WHEN {now} < {before} THEN {now} ELSE {now} - {before} END"


def delta(
    samples: DataFrame,
    cat: MetricCatalog,
    metrics: Sequence[str] | None = None,
    params: Sequence[str] | None = None,
    step: int | str = 1,
    block: int = BLOCK,
) -> DataFrame:
    """Samples with ``ts_diff_seconds`` and a ``<metric>_diff`` for each status metric."""
    metrics = cat.status_in(samples.columns) if metrics is None else list(metrics)
    params = cat.params_in(samples.columns) if params is None else list(params)
    extra = [step] if isinstance(step, str) and step not in params else []
    narrow = samples.select("host", "id", "ts", *metrics, *params, *extra)
    return changes_of(adjacent(narrow, metrics, step, block), cat, metrics, params)


def changes_of(pairs: DataFrame, cat: MetricCatalog, metrics: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Rows beside the values before (``prev_ts``, ``prev_<metric>``) as changes."""
    return pairs.selectExpr(
        "host",
        "id",
        "ts",
        "timestampdiff(SECOND, prev_ts, ts) AS ts_diff_seconds",
        *metrics,
        *[f"{change(m, cat.is_gauge(m))} AS `{m}_diff`" for m in metrics],
        *params,
    )


def delta_between(current: DataFrame, earlier: DataFrame, cat: MetricCatalog, metrics: Sequence[str],
                  params: Sequence[str] = (), step: int | str = 1) -> DataFrame:
    """Deltas of a few rows whose predecessors are looked up in another set of samples.

    The number of the predecessor is worked out on the side of ``current``, so each row may have a step of its own.
    """
    before = earlier.select(
        "host", F.col("id").alias("_before"), F.col("ts").alias("prev_ts"),
        *[F.col(m).alias(f"prev_{m}") for m in metrics],
    )
    rows = current.select(*sample_columns(metrics, params, step)).withColumn("_before", number_before(step))
    return changes_of(rows.join(before, ["host", "_before"]), cat, metrics, params)


def sample_columns(metrics: Sequence[str], params: Sequence[str], step: int | str = 1) -> list[str]:
    """Columns of samples that an incremental step stores; a step column is kept, whether it is a parameter or not."""
    extra = [step] if isinstance(step, str) and step not in [*metrics, *params] else []
    return ["host", "id", "ts", *metrics, *params, *extra]


def followers(table: DataFrame, changed: DataFrame, step: int | str = 1) -> DataFrame:
    """Rows of a table that are compared with a changed row (host, id): with a step column not always the next number."""
    keys = changed.select("host", F.col("id").alias("_before")).distinct()
    return table.withColumn("_before", number_before(step)).join(keys, ["host", "_before"], "left_semi").drop("_before")


def delta_since(samples: DataFrame, cat: MetricCatalog, since: Column, metrics: Sequence[str],
                params: Sequence[str] = (), lookback_days: int = 1, step: int | str = 1) -> DataFrame:
    """``delta`` of the samples from ``since`` on, without reading the whole history.

    A table that is opened with its ``day`` folders is read from the day of the edge on. The few samples without a
    predecessor in that range, from hosts silent for ``lookback_days``, are counted, and only if there are any the older
    part is searched for just their predecessors.
    """
    edge = (since - F.make_dt_interval(F.lit(lookback_days))).cast(NTZ)
    columns = sample_columns(metrics, params, step)
    by_day = "day" in samples.columns
    near = samples.where(F.col("ts") >= edge)
    near = (near.where(F.col("day") >= F.to_date(edge)) if by_day else near).select(*columns)
    changes = delta(near, cat, metrics, params, step).where(F.col("ts") >= since)
    if isinstance(step, str):  # any row may reach back beyond the edge
        recent = near.where(F.col("ts") >= since)
        alone = recent.join(changes.select("host", "id"), ["host", "id"], "left_anti")
    else:  # numbers of a host rise with time, so only its first row may
        first = near.groupBy("host").agg(F.min_by(F.struct(*columns), F.col("id")).alias("_row")).select("_row.*")
        alone = first.where(F.col("ts") >= since)
    alone = materialize(alone, "unpaired")
    if alone.isEmpty():
        return changes
    older = samples.where(F.col("ts") < edge)
    older = older.where(F.col("day") <= F.to_date(edge)) if by_day else older
    return changes.unionByName(delta_between(alone, older, cat, metrics, params, step))


def rates(deltas: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Add ``<metric>_psec``; works on samples and on rollups (change over summed seconds)."""
    return deltas.selectExpr("*", *[f"{rate_text(f'{m}_diff', 'ts_diff_seconds')} AS `{m}_psec`" for m in metrics])


def samples_view(samples: DataFrame, cat: MetricCatalog, metrics: Sequence[str] | None = None,
                 params: Sequence[str] | None = None, step: int | str = 1) -> DataFrame:
    """Values, changes and rates of status metrics beside the parameters."""
    metrics = cat.status_in(samples.columns) if metrics is None else list(metrics)
    return rates(delta(samples, cat, metrics, params, step), metrics)


def param_changes(
    samples: DataFrame,
    cat: MetricCatalog,
    params: Sequence[str] | None = None,
    step: int | str = 1,
    block: int = BLOCK,
) -> DataFrame:
    """One row per parameter that differs from the previous sample; NULL on either side is no change.

    All parameters share one window. Rows where nothing changed are dropped before the fan-out.
    """
    params = [p for p in (cat.params_in(samples.columns) if params is None else params) if p != "timestamp"]
    extra = [step] if isinstance(step, str) and step not in params else []
    pairs = adjacent(samples.select("host", "id", "ts", *params, *extra), params, step, block)
    changed = F.lit(False)
    for p in params:
        changed = changed | F.coalesce(F.col(p) != F.col(f"prev_{p}"), F.lit(False))
    kind = "decimal(20,0)" if any(cat.type_of(p) != "long" for p in params) else "long"
    entries = F.array(
        *[
            F.struct(
                F.lit(p).alias("variable_name"),
                F.col(f"prev_{p}").cast(kind).alias("old_value"),
                F.col(p).cast(kind).alias("new_value"),
            )
            for p in params
        ]
    )
    fanned = pairs.where(changed).select("host", "ts", F.inline(entries))
    return fanned.where(F.col("new_value") != F.col("old_value"))
