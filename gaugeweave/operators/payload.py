"""Series payloads: axis bounds, compact encodings, assembly and decoding.

Series stay in long form (host, series, step, value). Every group is one host and one chart over a
recent window, so its size is bounded by the window and not by the history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.catalog import CHARTS, SERIES_COLORS, Chart
from gaugeweave.functions.numeric import strict_greatest, strict_least
from gaugeweave.functions.text import cut, joined, plus_spaces, trimmed
from gaugeweave.functions.timefn import NTZ, plus_seconds, stamp
from gaugeweave.operators.rollup import minmax_long

# Level characters, lowest first, and the mark of a missing value.
LEVELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
MISSING = "_"


@dataclass(frozen=True)
class Canvas:
    """Size of a chart and the address its payload starts with."""

    width: int = 370
    height: int = 180
    service_url: str = "http://chart.apis.google.com/chart"


def chart_table(spark: SparkSession, charts: Sequence[Chart] = CHARTS) -> DataFrame:
    """The chart list as rows (alias, pos, metric, from_zero, to_hundred); a few hundred at most."""
    rows = [(c.alias, i, m, c.from_zero, c.to_hundred) for c in charts for i, m in enumerate(c.series)]
    return spark.createDataFrame(rows, "alias string, pos int, metric string, from_zero boolean, to_hundred boolean")


def long_series(series: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Gap-free series in long form (host, metric, timeseries_key, value)."""
    doubles = series.select("host", "timeseries_key", *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(["host", "timeseries_key"], list(metrics), "metric", "value")


def axis_bounds(ranges: DataFrame, charts: DataFrame) -> DataFrame:
    """Lowest and highest value of each chart; NULL when a series has no value at all."""
    low = F.when(F.count("low") == F.count(F.lit(1)), F.min("low"))
    high = F.when(F.count("high") == F.count(F.lit(1)), F.max("high"))
    bounds = ranges.join(charts, "metric").groupBy("host", "alias", "from_zero", "to_hundred").agg(
        low.alias("_low"), high.alias("_high")
    )
    return bounds.select(
        "host",
        "alias",
        F.when(F.col("from_zero"), strict_least(F.lit(0.0), F.col("_low"))).otherwise(F.col("_low")).alias("low"),
        F.when(F.col("to_hundred"), strict_greatest(F.lit(100.0), F.col("_high")))
        .otherwise(F.col("_high"))
        .alias("high"),
    )


def level(value: Column, low: Column, high: Column) -> Column:
    """One of 62 characters for the place of a value between the bounds."""
    zero = F.lit(0.0)
    floor = F.coalesce(low, zero)
    span = F.nullif(F.coalesce(high, zero) - floor, zero)
    place = F.floor(F.lit(61) * (value - floor) / span + F.lit(0.5)).cast("int")
    return F.coalesce(F.substring(F.lit(LEVELS), place + 1, F.lit(1)), F.lit(MISSING))


def _by_chart(points: DataFrame, mark: Column, between: str, separator: str) -> DataFrame:
    """Marks joined in step order per series, series joined in chart order."""
    series = points.groupBy("host", "alias", "pos").agg(joined(mark, between, F.col("timeseries_key")).alias("_text"))
    return series.groupBy("host", "alias").agg(joined(F.col("_text"), separator, F.col("pos")).alias("data"))


def encode_simple(series: DataFrame, bounds: DataFrame, charts: DataFrame) -> DataFrame:
    """(host, alias, data): one character per step, series separated by a comma."""
    points = series.join(charts, "metric").join(bounds, ["host", "alias"])
    return _by_chart(points, level(F.col("value"), F.col("low"), F.col("high")), "", ",")


def encode_text(series: DataFrame, ranges: DataFrame, charts: DataFrame) -> DataFrame:
    """(host, alias, data): numbers cut after the digits their range asks for, series separated by a bar."""
    points = series.join(charts, "metric").join(ranges.select("host", "metric", "round_digits"), ["host", "metric"])
    mark = F.coalesce(cut(F.col("value"), F.col("round_digits")), F.lit(MISSING))
    return _by_chart(points, mark, ",", "|")


def _legend(charts: Sequence[Chart]) -> tuple[Column, Column]:
    """Legend and colours of a chart by alias, as literal lookups."""
    names, colors = [], []
    for c in charts:
        names += [F.lit(c.alias), F.lit("|".join(c.series))]
        colors += [F.lit(c.alias), F.lit(",".join(SERIES_COLORS[: len(c.series)]))]
    alias = F.col("alias")
    return F.create_map(*names)[alias], F.create_map(*colors)[alias]


def payload(data: DataFrame, bounds: DataFrame, labels: DataFrame, spans: DataFrame, encoding: str,
            charts: Sequence[Chart] = CHARTS, canvas: Canvas = Canvas()) -> DataFrame:
    """(host, alias, payload); NULL when any part is NULL. ``encoding`` is ``"s"`` or ``"t"``."""
    legend, colors = _legend(charts)
    rows = (
        data.join(bounds, ["host", "alias"])
        .join(labels, "host")
        .join(spans.select("host", F.col("ts_min").cast(NTZ).alias("_start")), "host")
    )
    head = f"{canvas.service_url}?cht=lc&chs={canvas.width}x{canvas.height}&chts="
    start = F.col("_start")
    text = F.concat(
        F.lit(head), F.col("chart_title_color"), F.lit(",12&chtt="), F.col("chart_time_description"),
        F.lit("&chf=c,s,"), F.col("chart_bg_color"),
        F.lit("&chdl="), legend, F.lit("&chdlp=b&chco="), colors,
        F.lit(f"&chd={encoding}:"), F.col("data"),
        F.lit("&chxt=x,y&chxr=1,"), trimmed(F.col("low")), F.lit(","), trimmed(F.col("high")),
        F.lit("&chxl=0:|"), F.col("x_axis_labels"), F.lit("|&chxs=0,505050,10,0,lt"),
        F.lit("&chg="), F.col("x_axis_step_size"), F.lit(",25,1,2,"), F.col("x_axis_offset"), F.lit(",0"),
        F.lit("&chxp=0,"), F.col("x_axis_labels_positions"),
        F.lit("&tsstart="), stamp(start), F.lit("&tsstep="), F.col("ts_step_seconds").cast("string"),
    )
    return rows.select("host", "alias", plus_spaces(text).alias("payload"))


def profile_payload(profile: DataFrame, metrics: Mapping[str, int] | Sequence[str],
                    canvas: Canvas = Canvas()) -> DataFrame:
    """(host, metric, payload) of weekday-by-hour profiles; a cell without a value is marked."""
    names = list(metrics)
    ranges = minmax_long(profile, names).select("host", "metric", "low", "high")
    doubles = profile.select("host", "wd", "hr", *[F.col(m).cast("double").alias(m) for m in names])
    cells = doubles.unpivot(["host", "wd", "hr"], names, "metric", "value").join(ranges, ["host", "metric"])
    floor = strict_least(F.lit(0.0), F.col("low"))
    span = F.nullif(F.col("high") - floor, F.lit(0.0))
    size = F.floor(F.lit(100) * (F.col("value") - floor) / span + F.lit(0.5)).cast("long")
    order = [F.col("wd"), F.col("hr")]

    def scaled(part: str, last: int) -> Column:
        return F.floor(F.col(part) * F.lit(100) / F.lit(last) + F.lit(0.5)).cast("long").cast("string")

    lists = cells.groupBy("host", "metric").agg(
        joined(scaled("hr", 23), ",", *order).alias("x"),
        joined(scaled("wd", 6), ",", *order).alias("y"),
        joined(F.coalesce(size.cast("string"), F.lit(MISSING)), ",", *order).alias("sizes"),
    )
    hours = "|".join(f"{h:02d}" for h in range(24))
    text = F.concat(
        F.lit(f"{canvas.service_url}?cht=s&chs={canvas.width}x{canvas.height}&chts=303030,12&chtt="),
        F.col("metric"), F.lit("&chd=t:"), F.col("x"), F.lit("|"), F.col("y"), F.lit("|"), F.col("sizes"),
        F.lit(f"&chxt=x,y&chxl=0:|{hours}|1:|Mon|Tue|Wed|Thu|Fri|Sat|Sun&chm=o&chco=9aed32,ff8c00"),
    )
    return lists.select("host", "metric", plus_spaces(text).alias("payload"))


def decode_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Payload texts back to points (…, series, i, ts, value); other columns are kept."""
    query = F.replace(F.substring_index(column, "?", -1), F.lit("+"), F.lit(" "))
    keep = [c for c in payloads.columns if c != column]
    part = lambda name: F.regexp_extract(F.col("_q"), rf"(?:^|&){name}=([^&]*)", 1)
    data, axis = part("chd"), F.split(part("chxr"), ",")
    opened = payloads.where(F.col(column).isNotNull()).select(*keep, query.alias("_q")).select(
        *keep,
        F.substring(data, 1, 2).alias("_kind"),
        F.split(part("chdl"), "\\|").alias("_names"),
        F.substring_index(data, ":", -1).alias("_data"),
        axis[1].cast("double").alias("_low"),
        axis[2].cast("double").alias("_high"),
        F.to_timestamp_ntz(part("tsstart"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("_start"),
        part("tsstep").cast("long").alias("_step"),
    )
    simple = F.col("_kind") == "s:"
    per_series = F.when(simple, F.split("_data", ",")).otherwise(F.split("_data", "\\|"))
    by_series = opened.select("*", F.posexplode(per_series).alias("_s", "_points"))
    marks = F.when(simple, F.split("_points", "(?!^)(?!$)")).otherwise(F.split("_points", ","))
    points = by_series.select("*", F.posexplode(marks).alias("i", "_mark"))
    share = (F.position(F.col("_mark"), F.lit(LEVELS)) - 1) / 61
    value = F.when(F.col("_mark") == MISSING, None).when(
        simple, F.col("_low") + share * (F.col("_high") - F.col("_low"))
    ).otherwise(F.col("_mark").try_cast("double"))
    return points.select(
        *keep,
        F.get("_names", F.col("_s")).alias("series"),
        "i",
        plus_seconds(F.col("_start"), F.col("i") * F.col("_step")).alias("ts"),
        value.alias("value"),
    )


def rewrite_legend(text: Column, description: Column) -> Column:
    """Put the description of a custom query before its name in the legend."""
    told = F.coalesce(F.concat(plus_spaces(description), F.lit(":+")), F.lit(""))
    return F.replace(text, F.lit("&chdl=custom_"), F.concat(F.lit("&chdl="), told, F.lit("custom_")))


def section_table(spark: SparkSession, sections: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Report sections as rows (section_no, section, pos, alias)."""
    rows = [(i, name, j, a) for i, (name, aliases) in enumerate(sections) for j, a in enumerate(aliases)]
    return spark.createDataFrame(rows, "section_no int, section string, pos int, alias string")


def navigation(registry: DataFrame) -> DataFrame:
    """Ordered link list of the enabled custom charts of each host."""
    link = F.concat(F.lit('<a href="#custom_'), F.col("custom_query_id").cast("string"), F.lit('_chart">'),
                    F.col("description"), F.lit("</a>"))
    return registry.where(F.col("chart_enabled") == 1).groupBy("host").agg(
        joined(link, " | ", F.col("chart_order"), F.col("custom_query_id")).alias("custom_query_top_navigation")
    )


def csv_text(series: DataFrame, chart: Chart) -> DataFrame:
    """(host, csv): a header and one line per step with values rounded to two digits."""
    cells = [F.coalesce(F.round(F.col(m).cast("decimal(24,6)"), 2).cast("string"), F.lit("")) for m in chart.series]
    line = F.concat(F.concat_ws(",", stamp(F.col("timeseries_ts")), *cells), F.lit("\n"))
    lines = series.groupBy("host").agg(joined(line, "", F.col("timeseries_ts")).alias("_lines"))
    return lines.select("host", F.concat(F.lit("Date," + ",".join(chart.series) + "\n"), "_lines").alias("csv"))


def json_arrays(series: DataFrame, chart: Chart) -> DataFrame:
    """(host, x, one array text per series): minutes since the first step, and values with null."""
    stepped = series.select(
        "host", "timeseries_key", "timeseries_ts",
        *[F.round(F.col(m).cast("decimal(24,6)"), 2).cast("string").alias(m) for m in chart.series],
    )
    starts = F.min("timeseries_ts")
    rows = stepped.groupBy("host").agg(
        starts.alias("_start"),
        F.sort_array(F.collect_list("timeseries_ts")).alias("_times"),
        *[
            joined(F.coalesce(F.col(m), F.lit("null")), ",", F.col("timeseries_key")).alias(m)
            for m in chart.series
        ],
    )
    minutes = F.transform("_times", lambda t: F.timestamp_diff("MINUTE", F.col("_start"), t).cast("string"))
    return rows.select(
        "host",
        F.concat(F.lit("["), F.array_join(minutes, ","), F.lit("]")).alias("x"),
        *[F.concat(F.lit("["), F.col(m), F.lit("]")).alias(m) for m in chart.series],
    )
