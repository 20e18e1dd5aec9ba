"""Recent windows, gap-free series, axis ticks and titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.catalog import DAY, HOUR, SAMPLE, Grain
from gaugeweave.functions.numeric import ratio_units
from gaugeweave.functions.text import fixed
from gaugeweave.functions.timefn import NTZ, elapsed, floor_day, floor_hour, floor_minutes, floor_monday, ordinal_day
from gaugeweave.operators.ingest import join_host_facts


def recent_from(ts_latest: Column, grain: Grain) -> Column:
    """Start of the recent window that ends with the newest sample."""
    anchor = floor_minutes(ts_latest, 10) if grain.name == SAMPLE.name else ts_latest
    return (anchor - F.expr(f"interval {grain.recent}")).cast(NTZ)


def recent(rows: DataFrame, latest: DataFrame, grain: Grain, salts: int = 16) -> DataFrame:
    """Rows of the recent window of their host, with ``id_latest`` and ``ts_latest``."""
    joined = join_host_facts(rows, latest, F.col("ts"), salts)
    return joined.where(F.col("ts").cast(NTZ) >= recent_from(F.col("ts_latest"), grain))


def fill_gaps(rows: DataFrame, grain: Grain, columns: Sequence[str]) -> DataFrame:
    """One row per step from the first to the last bucket of a host; empty steps hold NULL."""
    ts = F.col("ts").cast(NTZ)
    span = rows.groupBy("host").agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    start = floor_minutes(F.col("_from"), 10) if grain.name == SAMPLE.name else F.col("_from")
    steps = F.sequence(start, F.col("_to"), F.make_dt_interval(secs=F.lit(grain.step_seconds)))
    grid = span.select("host", F.posexplode(steps).alias("timeseries_key", "timeseries_ts"))
    values = rows.select("host", ts.alias("timeseries_ts"), *columns)
    return grid.join(values, ["host", "timeseries_ts"], "left")


def tick_base(ts_min: Column, grain: Grain) -> Column:
    if grain.name == SAMPLE.name:
        return floor_hour(ts_min)
    if grain.name == HOUR.name:
        return floor_day(ts_min)
    return floor_monday(ts_min)


TICK_SECONDS = {"HOUR": 3600, "DAY": 86400, "WEEK": 604800}


def _tick_array(grain: Grain) -> Column:
    """Ticks inside the span as an array of (n, tick_ts); at most ``tick_limit`` + 1 candidates."""
    low, high = F.col("ts_min").cast(NTZ), F.col("ts_max").cast(NTZ)
    base, step = tick_base(low, grain), TICK_SECONDS[grain.tick]

    def at(n: Column) -> Column:
        moved = (base + F.make_dt_interval(secs=n * F.lit(step))).cast(NTZ)
        return F.struct(n.alias("n"), moved.alias("tick_ts"))

    every = F.transform(F.sequence(F.lit(0), F.lit(grain.tick_limit)), at)
    return F.filter(every, lambda t: (t["tick_ts"] >= low) & (t["tick_ts"] <= high))


def ticks(summary: DataFrame, grain: Grain) -> DataFrame:
    """Axis ticks of each host between its first and last bucket."""
    return summary.select("host", F.inline(_tick_array(grain)))


def tick_label(at: Column, grain: Grain) -> Column:
    if grain.name == SAMPLE.name:
        into = F.hour(at) % 4
        return F.when(into == 0, F.date_format(at, "HH:'00'")).when(into == 2, " ").otherwise("")
    if grain.name == HOUR.name:
        return ordinal_day(at)
    return F.lower(F.date_format(at, "MMM d"))


def _axis_units(grain: Grain) -> tuple[Column, Column]:
    """Tick distance and first tick as hundredths of a percent of the span."""
    low, high = F.col("ts_min").cast(NTZ), F.col("ts_max").cast(NTZ)
    if grain.name == SAMPLE.name:
        span, step, lead = elapsed("MINUTE", low, high), 60, (60 - F.minute(low)) % 60
    elif grain.name == HOUR.name:
        span, step, lead = elapsed("HOUR", low, high), 24, (24 - F.hour(low)) % 24
    else:
        span, step, lead = elapsed("DAY", low, high), 7, (7 - F.weekday(low)) % 7
    return ratio_units(F.lit(step * 100), span, 100), ratio_units(lead * 100, span, 100)


def is_stale(as_of: Column, grain: Grain) -> Column:
    return F.col("ts_max").cast(NTZ) < (as_of - F.expr(f"interval {grain.stale_after}")).cast(NTZ)


def title(as_of: Column, grain: Grain) -> Column:
    """Freshness, rounded length and both ends of the window."""
    low, high = F.col("ts_min").cast(NTZ), F.col("ts_max").cast(NTZ)
    if grain.name == SAMPLE.name:
        length, unit, shape = ratio_units(elapsed("MINUTE", low, high), F.lit(60), 1), "hours", "MMM d, HH:mm"
    else:
        length, unit = ratio_units(elapsed("HOUR", low, high), F.lit(24), 1), "days"
        shape = "MMM d, yyyy" if grain.name == DAY.name else "MMM d, HH:'00'"
    return F.concat(
        F.when(is_stale(as_of, grain), "STALE DATA! ").otherwise("Latest "),
        length.cast("string"),
        F.lit(f" {unit}: "),
        F.date_format(low, shape),
        F.lit("  -  "),
        F.date_format(high, shape),
    )


def axis_labels(summary: DataFrame, grain: Grain, as_of: Column) -> DataFrame:
    """Step, offset, labels, positions, title and colours of the time axis; row-wise, no shuffle.

    A host whose window holds no tick has no row.
    """
    step, offset = _axis_units(grain)
    rows = summary.select("host", "ts_min", "ts_max", _tick_array(grain).alias("_ticks"), step.alias("_step"),
                          offset.alias("_offset")).where(F.size("_ticks") > 0)
    late = tick_base(F.col("ts_min").cast(NTZ), grain) < F.col("ts_min").cast(NTZ)

    def position(t: Column) -> Column:
        steps = t["n"] - F.when(late, 1).otherwise(0)
        return fixed((F.col("_offset") + F.col("_step") * steps) / 100, 2)

    stale = is_stale(as_of, grain)
    return rows.select(
        "host",
        F.coalesce(fixed(F.col("_step") / 100, 2), F.lit("")).alias("x_axis_step_size"),
        F.coalesce(fixed(F.col("_offset") / 100, 2), F.lit("")).alias("x_axis_offset"),
        F.array_join(F.transform("_ticks", lambda t: tick_label(t["tick_ts"], grain)), "|").alias("x_axis_labels"),
        F.array_join(F.transform("_ticks", position), ",").alias("x_axis_labels_positions"),
        title(as_of, grain).alias("chart_time_description"),
        F.lit(grain.step_seconds).alias("ts_step_seconds"),
        F.when(stale, "808080").otherwise("303030").alias("chart_title_color"),
        F.when(stale, "f0f0f0").otherwise("ffffff").alias("chart_bg_color"),
    )
