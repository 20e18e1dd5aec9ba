"""Axis bounds, encodings, payloads, decoding and text exports."""

from pyspark.sql import functions as F

from gaugeweave.catalog import BRIEF_SECTIONS, CHARTS, HOUR, SAMPLE, Chart
from gaugeweave.checks.fixtures import CAT, as_of, ev_samples, table
from gaugeweave.checks.oracle import report_sql
from gaugeweave.checks.registry import Family
from gaugeweave.checks.rollup_queries import REGISTRY_SQL, averages_sql, minmax_columns, supplier_registry
from gaugeweave.checks.series_queries import filled_ctes, filled_of, labels_sql, recent_buckets
from gaugeweave.functions.text import cut
from gaugeweave.operators.payload import (
    LEVELS,
    Canvas,
    axis_bounds,
    csv_text,
    decode_payload,
    encode_simple,
    encode_text,
    json_arrays,
    navigation,
    rewrite_legend,
    section_table,
)
from gaugeweave.operators.reshape import custom_registry
from gaugeweave.operators.report import inputs_of
from gaugeweave.plans.charts import chart_inputs, chart_payloads, names_of, payloads, profile_payloads
from gaugeweave.session import materialize

FAMILY = Family()
PICKED = ("uptime_percent", "innodb_read_hit_percent", "innodb_io", "network_io", "myisam_key_hit", "connections_usage",
          "seconds_behind_master", "seconds_behind_master_psec", "os_memory")
DRAWN = tuple(c for c in CHARTS if c.alias in PICKED) + (Chart("custom_1", ("custom_1",)),)
NAMES = names_of(DRAWN)
GRAIN = {"sample": SAMPLE, "hour": HOUR}


def inputs(spark, sf, grain, charts=DRAWN):
    buckets = materialize(recent_buckets(spark, sf, grain, names_of(charts)), "buckets")
    return chart_inputs(buckets, grain, charts)


CHART_ROWS = ", ".join(
    f"('{c.alias}', {i}, '{m}', {c.from_zero}, {c.to_hundred}, {len(c.series)})"
    for c in DRAWN for i, m in enumerate(c.series)
)


def chart_ctes(grain):
    """CTEs: summary, charts, ranges, points, bounds."""
    ranges = " UNION ALL ".join(
        f"SELECT host, '{m}' AS metric, CAST({m}_min AS DOUBLE) AS low, CAST({m}_max AS DOUBLE) AS high, "
        f"{m}_round_digits AS digits FROM summary" for m in NAMES
    )
    points = " UNION ALL ".join(
        f"SELECT host, timeseries_key AS k, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM filled" for m in NAMES
    )
    return (
        f"{filled_ctes(grain, NAMES)}, summary AS (SELECT host, CAST(min(ts) AS TIMESTAMP) AS ts_min, "
        f"CAST(max(ts) AS TIMESTAMP) AS ts_max{minmax_columns(NAMES)} FROM buckets GROUP BY host), "
        f"charts(alias, pos, metric, from_zero, to_hundred, n) AS (VALUES {CHART_ROWS}), "
        f"ranges AS ({ranges}), points AS ({points}), raw_bounds AS (SELECT host, alias, from_zero, to_hundred, "
        "CASE WHEN bool_or(low IS NULL) THEN NULL ELSE min(low) END AS lo, "
        "CASE WHEN bool_or(high IS NULL) THEN NULL ELSE max(high) END AS hi "
        "FROM ranges JOIN charts USING (metric) GROUP BY ALL), bounds AS (SELECT host, alias, "
        "CASE WHEN lo IS NULL THEN NULL WHEN from_zero AND lo > 0 THEN 0.0 ELSE lo END AS low, "
        "CASE WHEN hi IS NULL THEN NULL WHEN to_hundred AND hi < 100 THEN 100.0 ELSE hi END AS high FROM raw_bounds)"
    )


LEVEL = (
    f"coalesce(substr('{LEVELS}', 1 + CAST(floor(61 * (v - coalesce(low, 0)) / "
    "nullif(coalesce(high, 0) - coalesce(low, 0), 0) + 0.5) AS INTEGER), 1), '_')"
)


def cut_sql(v, digits):
    """Decimal text of a double, cut: whole and decimals are parts of its digits, wherever its exponent puts the point."""
    text = f"CAST(abs({v}) AS VARCHAR)"
    mantissa = f"split_part({text}, 'e', 1)"
    figures = f"replace({mantissa}, '.', '')"
    place = f"(length(split_part({mantissa}, '.', 1)) + coalesce(TRY_CAST(split_part({text}, 'e', 2) AS INTEGER), 0))"
    # Zeros before and after, then counted from the point: no case distinction.
    padded = f"(repeat('0', 400) || {figures} || repeat('0', 400))"
    whole = f"coalesce(nullif(ltrim(substr({padded}, 1, 400 + {place}), '0'), ''), '0')"
    decimals = f"substr({padded}, 401 + {place}, {digits})"
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || {whole} || '.' || {decimals})"


CUT = f"coalesce({cut_sql('v', 'digits')}, '_')"


def simple_cte():
    return (
        f"series_s AS (SELECT host, alias, pos, string_agg({LEVEL}, '' ORDER BY k) AS t FROM points "
        "JOIN charts USING (metric) JOIN bounds USING (host, alias) GROUP BY host, alias, pos), "
        "simple AS (SELECT host, alias, string_agg(t, ',' ORDER BY pos) AS data FROM series_s GROUP BY host, alias)"
    )


def text_cte():
    return (
        f"series_t AS (SELECT host, alias, pos, string_agg({CUT}, ',' ORDER BY k) AS t FROM points "
        "JOIN charts USING (metric) JOIN (SELECT host, metric, digits FROM ranges) USING (host, metric) "
        "GROUP BY host, alias, pos), "
        "texts AS (SELECT host, alias, string_agg(t, '|' ORDER BY pos) AS data FROM series_t GROUP BY host, alias)"
    )


@FAMILY.add(
    "g1_chart_series",
    f"WITH {chart_ctes('sample')} SELECT host, alias, CAST(pos AS INTEGER) AS pos, metric, count(*) AS steps, count(v) AS "
    "measured FROM points JOIN charts USING (metric) GROUP BY ALL",
)
def g1(spark, sf):
    made = inputs(spark, sf, SAMPLE)
    return made.series.join(made.charts, "metric").groupBy("host", "alias", "pos", "metric").agg(
        F.count(F.lit(1)).alias("steps"), F.count("value").alias("measured"))


@FAMILY.add("g2_axis_bounds", f"WITH {chart_ctes('sample')} SELECT host, alias, low, high FROM bounds")
def g2(spark, sf):
    made = inputs(spark, sf, SAMPLE)
    return axis_bounds(made.ranges, made.charts)


@FAMILY.add("g3_quantised_encoding", f"WITH {chart_ctes('sample')}, {simple_cte()} SELECT * FROM simple")
def g3(spark, sf):
    made = inputs(spark, sf, SAMPLE)
    return encode_simple(made.series, axis_bounds(made.ranges, made.charts), made.charts)


SCALES = ("1e-20", "1e-9", "1e-7", "0.001", "1.0", "1e7", "1e10")
SCALED = "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN {{}} * CAST('{s}' AS DOUBLE)" for i, s in enumerate(SCALES)) + " END"


@FAMILY.add(
    "g4_text_any_digits",
    "WITH points AS (SELECT l_orderkey, l_linenumber, "
    f"{SCALED.replace('{}', '(CAST(l_extendedprice AS DOUBLE) / (1 + l_partkey) - 3)')} AS v, CAST(l_suppkey % 27 AS INTEGER) AS digits "
    f"FROM lineitem) SELECT l_orderkey, l_linenumber, digits, {cut_sql('v', 'digits')} AS shown FROM points",
)
def g4_any(spark, sf):
    value = SCALED.replace("{}", "(CAST(l_extendedprice AS DOUBLE) / (1 + l_partkey) - 3)")
    points = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{value} AS v", "CAST(l_suppkey % 27 AS INT) AS digits")
    return points.select("l_orderkey", "l_linenumber", "digits", cut(F.col("v"), F.col("digits")).alias("shown"))


@FAMILY.add("g4_text_encoding", f"WITH {chart_ctes('sample')}, {text_cte()} SELECT * FROM texts")
def g4(spark, sf):
    made = inputs(spark, sf, SAMPLE)
    return encode_text(made.series, made.ranges, made.charts)


SHORT = "rtrim(rtrim(CAST(CAST({0} AS DECIMAL(24,6)) AS VARCHAR), '0'), '.')"
CANVAS = Canvas()
COLORS = {c.alias: ",".join("ff8c00 4682b4 9acd32 dc143c 9932cc ffd700".split()[: len(c.series)]) for c in DRAWN}


def payload_select(encoding):
    legend = "CASE alias " + " ".join(f"WHEN '{c.alias}' THEN '{'|'.join(c.series)}'" for c in DRAWN) + " END"
    colors = "CASE alias " + " ".join(f"WHEN '{a}' THEN '{v}'" for a, v in COLORS.items()) + " END"
    source = "simple" if encoding == "s" else "texts"
    return (
        "SELECT host, alias, replace("
        f"'{CANVAS.service_url}?cht=lc&chs={CANVAS.width}x{CANVAS.height}&chts=' || chart_title_color || ',12&chtt=' || "
        f"chart_time_description || '&chf=c,s,' || chart_bg_color || '&chdl=' || {legend} || '&chdlp=b&chco=' || {colors} "
        f"|| '&chd={encoding}:' || data || '&chxt=x,y&chxr=1,' || {SHORT.format('low')} || ',' || {SHORT.format('high')} "
        "|| '&chxl=0:|' || x_axis_labels || '|&chxs=0,505050,10,0,lt&chg=' || x_axis_step_size || ',25,1,2,' || "
        "x_axis_offset || ',0&chxp=0,' || x_axis_labels_positions || '&tsstart=' || "
        "strftime(ts_min, '%Y-%m-%d %H:%M:%S') || '&tsstep=' || CAST(ts_step_seconds AS VARCHAR), ' ', '+') AS payload "
        f"FROM {source} JOIN bounds USING (host, alias) JOIN labels USING (host) JOIN summary USING (host)"
    )


def payload_sql(grain, encoding):
    data = simple_cte() if encoding == "s" else text_cte()
    return f"WITH {chart_ctes(grain)}, {data}, {labels_sql(grain)} {payload_select(encoding)}"


def _payload_query(key, grain, encoding):
    @FAMILY.add(key, payload_sql(grain.name, encoding))
    def query(spark, sf):
        return payloads(inputs(spark, sf, grain), as_of(), DRAWN, encoding)


_payload_query("g5_payload_quantised", SAMPLE, "s")
_payload_query("g5_payload_text", SAMPLE, "t")
_payload_query("g5_payload_hour", HOUR, "s")


@FAMILY.add("g5_payload_all_charts")
def all_charts(spark, sf):
    """Every chart of the catalogue from the samples in one plan; checked piecewise by the queries above."""
    from gaugeweave.checks.fixtures import PARAM_COLUMNS, STATUS

    return chart_payloads(ev_samples(spark, sf, [*STATUS, *PARAM_COLUMNS]), SAMPLE, as_of(), CAT)


PROFILED = ["innodb_read_hit_percent", "mega_bytes_sent_psec", "com_select_psec", "com_set_option_percent",
            "seconds_behind_master", "os_loadavg", "os_cpu_utilization_percent", "os_mem_used_mb"]
SHARE = "100 * (v - CASE WHEN low > 0 THEN 0 ELSE low END) / nullif(high - CASE WHEN low > 0 THEN 0 ELSE low END, 0)"


@FAMILY.add(
    "g6_profile_payload",
    f"WITH {report_sql(PROFILED)}, cells AS (SELECT host, isodow(ts) - 1 AS wd, hour(ts) AS hr{averages_sql(PROFILED)} "
    "FROM report GROUP BY host, isodow(ts), hour(ts)), long AS ("
    + " UNION ALL ".join(f"SELECT host, wd, hr, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM cells" for m in PROFILED)
    + "), r AS (SELECT host, metric, min(v) AS low, max(v) AS high FROM long GROUP BY host, metric) "
    f"SELECT host, metric, '{CANVAS.service_url}?cht=s&chs={CANVAS.width}x{CANVAS.height}&chts=303030,12&chtt=' || metric "
    "|| '&chd=t:' || string_agg(CAST(CAST(floor(hr * 100 / 23 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY wd, hr) || '|' || "
    "string_agg(CAST(CAST(floor(wd * 100 / 6 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY wd, hr) || '|' || "
    f"string_agg(coalesce(CAST(CAST(floor({SHARE} + 0.5) AS BIGINT) AS VARCHAR), '_'), ',' ORDER BY wd, hr) || "
    f"'&chxt=x,y&chxl=0:|{'|'.join(f'{h:02d}' for h in range(24))}|1:|Mon|Tue|Wed|Thu|Fri|Sat|Sun&chm=o&chco=9aed32,ff8c00' "
    "AS payload FROM long JOIN r USING (host, metric) GROUP BY host, metric",
)
def g6(spark, sf):
    needs = inputs_of(PROFILED, CAT)
    return profile_payloads(ev_samples(spark, sf, [*needs.metrics, *needs.params]), CAT, PROFILED)


BOUND = "CAST(CAST({0} AS DECIMAL(24,6)) AS DOUBLE)"


def _decode_sql(encoding):
    if encoding == "s":
        index = f"(strpos('{LEVELS}', mark) - 1)"
        value = (
            f"CASE WHEN mark = '_' THEN NULL ELSE {BOUND.format('low')} + CAST({index} AS DOUBLE) / 61 * "
            f"({BOUND.format('high')} - {BOUND.format('low')}) END"
        )
        mark = LEVEL
        extra = ""
    else:
        value, mark = "CASE WHEN mark = '_' THEN NULL ELSE CAST(mark AS DOUBLE) END", CUT
        extra = "JOIN (SELECT host, metric, digits FROM ranges) USING (host, metric) "
    return (
        f"WITH {chart_ctes('sample')}, {labels_sql('sample')}, marks AS (SELECT points.*, alias, low, high, {mark} AS mark "
        f"FROM points JOIN charts USING (metric) JOIN bounds USING (host, alias) {extra}) "
        f"SELECT host, alias, metric AS series, k AS i, ts_min + k * INTERVAL 600 SECOND AS ts, {value} AS value "
        "FROM marks JOIN summary USING (host) JOIN (SELECT host FROM labels) USING (host) "
        "WHERE low IS NOT NULL AND high IS NOT NULL"
    )


def _decode_query(key, encoding):
    @FAMILY.add(key, _decode_sql(encoding))
    def query(spark, sf):
        return decode_payload(payloads(inputs(spark, sf, SAMPLE), as_of(), DRAWN, encoding))


_decode_query("g7_decode_quantised", "s")
_decode_query("g7_decode_text", "t")

@FAMILY.add(
    "g8_legend_rewrite",
    f"WITH {chart_ctes('sample')}, {simple_cte()}, {labels_sql('sample')}, p AS ({payload_select('s')}) SELECT host, alias, "
    "replace(payload, '&chdl=custom_', '&chdl=Value+of+' || host || ':+custom_') AS payload FROM p",
)
def g8(spark, sf):
    made = payloads(inputs(spark, sf, SAMPLE), as_of(), DRAWN, "s")
    told = F.concat(F.lit("Value of "), F.col("host"))
    return made.select("host", "alias", rewrite_legend(F.col("payload"), told).alias("payload"))


SECTION_ROWS = ", ".join(
    f"({i}, '{name}', {j}, '{a}')" for i, (name, aliases) in enumerate(BRIEF_SECTIONS) for j, a in enumerate(aliases)
)


@FAMILY.add(
    "g9_brief_sections",
    f"WITH {chart_ctes('sample')}, {simple_cte()}, {labels_sql('sample')}, p AS ({payload_select('s')}), "
    f"sections(section_no, section, pos, alias) AS (VALUES {SECTION_ROWS}) SELECT host, CAST(section_no AS INTEGER) AS "
    "section_no, section, CAST(pos AS INTEGER) AS pos, alias, payload FROM p JOIN sections USING (alias)",
)
def g9_sections(spark, sf):
    made = payloads(inputs(spark, sf, SAMPLE), as_of(), DRAWN, "s")
    return made.join(section_table(spark, BRIEF_SECTIONS), "alias")


@FAMILY.add(
    "g9_navigation",
    f"WITH {REGISTRY_SQL} SELECT host, string_agg('<a href=\"#custom_' || custom_query_id || '_chart\">' || description "
    "|| '</a>', ' | ' ORDER BY chart_order, custom_query_id) AS custom_query_top_navigation "
    "FROM registry WHERE chart_type <> 'none' GROUP BY host",
)
def g9(spark, sf):
    return navigation(custom_registry(supplier_registry(spark, sf)))


EXPORTED = Chart("export", ("com_select_psec", "threads_connected"))
TWO = "CAST(round(CAST({0} AS DECIMAL(24,6)), 2) AS VARCHAR)"


@FAMILY.add(
    "a17_series_csv",
    f"WITH {filled_ctes('sample', list(EXPORTED.series))} SELECT host, 'Date,com_select_psec,threads_connected' || chr(10) || "
    "string_agg(strftime(timeseries_ts, '%Y-%m-%d %H:%M:%S')"
    + "".join(f" || ',' || coalesce({TWO.format(m)}, '')" for m in EXPORTED.series)
    + " || chr(10), '' ORDER BY timeseries_key) AS csv FROM filled GROUP BY host",
)
def a17(spark, sf):
    return csv_text(filled_of(spark, sf, SAMPLE, list(EXPORTED.series)), EXPORTED)


@FAMILY.add(
    "a18_series_json_arrays",
    f"WITH {filled_ctes('sample', list(EXPORTED.series))} SELECT host, "
    "'[' || string_agg(CAST(timeseries_key * 10 AS VARCHAR), ',' ORDER BY timeseries_key) || ']' AS x"
    + "".join(
        f", '[' || string_agg(coalesce({TWO.format(m)}, 'null'), ',' ORDER BY timeseries_key) || ']' AS {m}"
        for m in EXPORTED.series
    )
    + " FROM filled GROUP BY host",
)
def a18(spark, sf):
    return json_arrays(filled_of(spark, sf, SAMPLE, list(EXPORTED.series)), EXPORTED)
