from pyspark.sql import functions as F

from gaugeweave.catalog import DAY, HOUR, SAMPLE
from gaugeweave.functions.timefn import NTZ
from gaugeweave.operators.payload import LEVELS, decode_payload, level, profile_payload, rewrite_legend
from gaugeweave.operators.series import axis_labels
from conftest import rows_of

HOURS = "0,4,9,13,17,22,26,30,35,39,43,48,52,57,61,65,70,74,78,83,87,91,96,100"


def axis(spark, grain, low, high, as_of="2010-11-10 06:00:00"):
    span = spark.sql(f"SELECT 'a' AS host, TIMESTAMP_NTZ '{low}' AS ts_min, TIMESTAMP_NTZ '{high}' AS ts_max")
    return axis_labels(span, grain, F.lit(as_of).cast(NTZ)).first()


def test_day_of_samples(spark):
    row = axis(spark, SAMPLE, "2010-11-09 05:50:00", "2010-11-10 05:50:00")
    assert (row.x_axis_step_size, row.x_axis_offset) == ("4.17", "0.69")
    assert row.x_axis_labels == " ||08:00|| ||12:00|| ||16:00|| ||20:00|| ||00:00|| ||04:00|"
    assert row.x_axis_labels_positions.startswith("0.69,4.86,9.03,13.20,17.37")
    assert row.x_axis_labels_positions.endswith("96.60")
    assert row.chart_time_description == "Latest 24 hours: Nov 9, 05:50  -  Nov 10, 05:50"
    assert (row.chart_title_color, row.chart_bg_color) == ("303030", "ffffff")


def test_ten_days_of_hours(spark):
    row = axis(spark, HOUR, "2010-10-31 06:00:00", "2010-11-10 05:00:00")
    assert (row.x_axis_step_size, row.x_axis_offset) == ("10.04", "7.53")
    assert row.x_axis_labels == "1st|2nd|3rd|4th|5th|6th|7th|8th|9th|10th"


def test_weeks_of_days(spark):
    row = axis(spark, DAY, "2010-10-04 00:00:00", "2010-11-10 00:00:00")
    assert (row.x_axis_step_size, row.x_axis_offset) == ("18.92", "0.00")
    assert row.x_axis_labels == "oct 4|oct 11|oct 18|oct 25|nov 1|nov 8"
    assert row.x_axis_labels_positions == "0.00,18.92,37.84,56.76,75.68,94.60"
    assert row.chart_time_description == "Latest 37 days: Oct 4, 2010  -  Nov 10, 2010"


def test_stale_title(spark):
    row = axis(spark, SAMPLE, "2010-11-09 05:50:00", "2010-11-10 05:50:00", as_of="2010-11-10 07:00:01")
    assert row.chart_time_description.startswith("STALE DATA! 24 hours")
    assert (row.chart_title_color, row.chart_bg_color) == ("808080", "f0f0f0")


def test_levels(spark):
    values = [0.0, 50.0, 100.0, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    marks = frame.select("i", level(F.col("v"), F.lit(0.0), F.lit(100.0)).alias("m"))
    assert [m for _, m in rows_of(marks, "i", "m")] == ["A", "f", "9", "_"]
    flat = spark.range(1).select(level(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("m"))
    assert flat.first().m == "_"


HEAD = "http://chart.apis.google.com/chart?cht=lc&chs=370x180&chts=303030,12&chtt=Latest&chf=c,s,ffffff&chdl=one|two&chdlp=b"
TAIL = "&chxt=x,y&chxr=1,{lo},{hi}&chxl=0:|a|&chxs=0,505050,10,0,lt&chg=4.17,25,1,2,0.69,0&chxp=0,0.69&tsstart=2010-11-09+05:50:00&tsstep=600"


def decoded(spark, data, lo, hi):
    text = HEAD + f"&chd={data}" + TAIL.format(lo=lo, hi=hi)
    frame = spark.createDataFrame([("a", text)], "host string, payload string")
    return rows_of(decode_payload(frame).withColumn("t", F.date_format("ts", "HH:mm")), "series", "i", "t", "value")


def test_decode_twins_agree_within_half_a_level(spark):
    text = decoded(spark, "t:0.00,25.40,100.00|99.85,_,-2.39", -10, 110)
    mark = {v: LEVELS[int(61 * (v + 10) / 120 + 0.5)] for v in (0.0, 25.4, 100.0, 99.85, -2.39)}
    data = "s:" + mark[0.0] + mark[25.4] + mark[100.0] + "," + mark[99.85] + "_" + mark[-2.39]
    coarse = decoded(spark, data, -10, 110)
    assert [r[:3] for r in text] == [r[:3] for r in coarse] == [
        (s, i, t) for s in ("one", "two") for i, t in enumerate(("05:50", "06:00", "06:10"))]
    for fine, rough in zip(text, coarse):
        if fine[3] is None:
            assert rough[3] is None
        else:
            assert abs(fine[3] - rough[3]) <= 120 / 61 / 2 + 0.01


def test_profile_axes(spark):
    cells = spark.sql("SELECT 'a' AS host, CAST(d.id AS INT) AS wd, CAST(h.id AS INT) AS hr, "
                      "CASE WHEN h.id = 3 THEN NULL ELSE CAST(h.id AS DOUBLE) END AS m FROM range(7) d, range(24) h")
    data = profile_payload(cells, ["m"]).first().payload.split("chd=t:")[1].split("&")[0].split("|")
    assert data[0] == ",".join([HOURS] * 7)
    assert data[1].split(",")[::24] == ["0", "17", "33", "50", "67", "83", "100"]
    assert data[2].split(",")[:5] == ["0", "4", "9", "_", "17"]


def test_legend(spark):
    made = rewrite_legend(F.lit("x&chdl=custom_1&y"), F.lit("Open orders"))
    assert spark.range(1).select(made.alias("t")).first().t == "x&chdl=Open+orders:+custom_1&y"
    bare = rewrite_legend(F.lit("x&chdl=custom_1&y"), F.lit(None).cast("string"))
    assert spark.range(1).select(bare.alias("t")).first().t == "x&chdl=custom_1&y"


