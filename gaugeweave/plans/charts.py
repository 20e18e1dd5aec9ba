"""From samples to chart payloads, one grain at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeweave.catalog import CHARTS, PROFILE_METRICS, SAMPLE, Chart, Grain, MetricCatalog
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.delta import delta, delta_since, latest, rates
from gaugeweave.operators.payload import (
    Canvas,
    axis_bounds,
    chart_table,
    encode_simple,
    encode_text,
    long_series,
    payload,
    profile_payload,
)
from gaugeweave.operators.report import digits_of, inputs_of, report
from gaugeweave.operators.rollup import bucket_avg, minmax, minmax_long, profile_24_7, rollup
from gaugeweave.operators.series import axis_labels, fill_gaps, recent, recent_from
from gaugeweave.session import materialize


def report_of(samples: DataFrame, grain: Grain, names: Sequence[str], cat: MetricCatalog,
              step: int | str = 1, since: Column | None = None) -> DataFrame:
    """Report metrics at a grain, computed from samples; nothing the metrics do not read is touched.

    With ``since``, the start of a bucket, older samples are not scanned either.
    """
    needs = inputs_of(names, cat)
    if since is None or step != 1:
        rows = delta(samples, cat, needs.metrics, needs.params, step)
    else:
        rows = delta_since(samples, cat, since, needs.metrics, needs.params)
    return report_rows(rows, grain, names, cat)


def report_rows(deltas: DataFrame, grain: Grain, names: Sequence[str], cat: MetricCatalog) -> DataFrame:
    needs = inputs_of(names, cat)
    rows = deltas if grain.name == SAMPLE.name else rollup(deltas, grain, needs.metrics, needs.params)
    return report(rates(rows, needs.rates), names, cat)


def report_of_rollup(rolled: DataFrame, names: Sequence[str], cat: MetricCatalog) -> DataFrame:
    """Report metrics of a stored hour or day rollup: the cheap way to those grains."""
    return report(rates(rolled, inputs_of(names, cat).rates), names, cat)


def scan_start(newest: DataFrame, grain: Grain) -> Column:
    """Start of the day in which the earliest recent window of any host begins, as a literal.

    It reaches the file scan, so folders and row groups before it are skipped.
    """
    first = newest.agg(F.min(recent_from(F.col("ts_latest"), grain)).alias("t")).first().t
    return F.date_trunc("DAY", F.lit(first)).cast(NTZ)


def recent_buckets(rows: DataFrame, newest: DataFrame, grain: Grain, names: Sequence[str],
                   cat: MetricCatalog) -> DataFrame:
    """The rows a chart draws: ten-minute averages of samples, or the rollup rows themselves."""
    kept = recent(rows, newest, grain)
    return bucket_avg(kept, digits_of(names, cat.custom_ids)) if grain.name == SAMPLE.name else kept


@dataclass(frozen=True)
class ChartInputs:
    """What the payloads of one grain are made from; buckets are written once and read by each part."""

    buckets: DataFrame
    summary: DataFrame
    ranges: DataFrame
    series: DataFrame
    charts: DataFrame
    grain: Grain


def names_of(charts: Sequence[Chart]) -> list[str]:
    return list(dict.fromkeys(m for c in charts for m in c.series))


def chart_inputs(buckets: DataFrame, grain: Grain, charts: Sequence[Chart]) -> ChartInputs:
    names = names_of(charts)
    return ChartInputs(
        buckets,
        minmax(buckets, []),
        minmax_long(buckets, names),
        long_series(fill_gaps(buckets, grain, names), names),
        chart_table(buckets.sparkSession, charts),
        grain,
    )


def payloads(inputs: ChartInputs, as_of: Column, charts: Sequence[Chart], encoding: str,
             canvas: Canvas = Canvas()) -> DataFrame:
    """(host, alias, payload) of all charts, quantised (``"s"``) or as text (``"t"``)."""
    bounds = axis_bounds(inputs.ranges, inputs.charts)
    if encoding == "s":
        data = encode_simple(inputs.series, bounds, inputs.charts)
    else:
        data = encode_text(inputs.series, inputs.ranges, inputs.charts)
    labels = axis_labels(inputs.summary, inputs.grain, as_of)
    return payload(data, bounds, labels, inputs.summary, encoding, charts, canvas)


def chart_payloads(samples: DataFrame, grain: Grain, as_of: Column, cat: MetricCatalog,
                   charts: Sequence[Chart] = CHARTS, encoding: str = "s", step: int | str = 1,
                   newest: DataFrame | None = None) -> DataFrame:
    """All chart payloads of a grain. The small recent part is written out once and shared.

    ``newest`` is the table of a ``NewestIndex``; without it the newest rows are looked for in the whole of ``samples``.
    """
    names = names_of(charts)
    newest = materialize(latest(samples) if newest is None else newest, "latest")
    rows = report_of(samples, grain, names, cat, step, scan_start(newest, grain))
    buckets = materialize(recent_buckets(rows, newest, grain, names, cat), f"recent-{grain.name}")
    return payloads(chart_inputs(buckets, grain, charts), as_of, charts, encoding)


def profile_payloads(samples: DataFrame, cat: MetricCatalog, names: Sequence[str] = PROFILE_METRICS,
                     step: int | str = 1) -> DataFrame:
    """(host, metric, payload) of the weekday-by-hour profiles over the whole history."""
    rows = report_of(samples, SAMPLE, names, cat, step)
    profile = materialize(profile_24_7(rows, digits_of(names, cat.custom_ids)), "profile")
    return profile_payload(profile, names)
