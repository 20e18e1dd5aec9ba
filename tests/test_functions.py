import datetime as dt
from decimal import ROUND_HALF_UP, Decimal
import random

import pytest
from pyspark.sql import functions as F

from gaugeweave.functions.numeric import ratio_text, ratio_units, round_digits, strict_greatest, strict_least
from gaugeweave.functions.text import cut, trimmed
from gaugeweave.functions.timefn import NTZ, clock, floor_minutes, floor_monday, ordinal_day


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_ratio_equals_exact_decimal_rounding(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-10**12, 10**12), rng.randrange(-999, 1000)) for _ in range(2000)]
    pairs += [(69, 120), (-69, 120), (69, -120), (5, 0), (0, 7), (None, 3), (3, None), (1, 8), (-1, 8)]
    frame = spark.createDataFrame(pairs, "n long, d long")
    rows = frame.select("n", "d", ratio_units(F.col("n"), F.col("d"), 100).alias("a"),
                        F.expr(ratio_text("n", "d", 100)).alias("b")).collect()
    for n, d, a, b in rows:
        want = None
        if n is not None and d:
            want = int((Decimal(n) * 100 / Decimal(d)).quantize(Decimal(1), ROUND_HALF_UP))
        assert a == b == want, (n, d)


@pytest.mark.parametrize("span, digits", [(0.01, 5), (480.0, 1), (0.0, 1), (None, 1)])
def test_round_digits(spark, span, digits):
    assert one(spark, round_digits(F.lit(0.0), F.lit(span).cast("double"))) == digits


def test_strict_bounds(spark):
    nothing = F.lit(None).cast("double")
    assert one(spark, strict_least(F.lit(0.0), nothing)) is None
    assert one(spark, strict_greatest(F.lit(100.0), nothing)) is None
    assert one(spark, strict_least(F.lit(0.0), F.lit(-2.0))) == -2.0


def test_ten_minute_floor(spark):
    ts = F.lit("2024-01-01 12:19:59").cast(NTZ)
    assert one(spark, floor_minutes(ts, 10)) == dt.datetime(2024, 1, 1, 12, 10)


def test_monday(spark):
    assert one(spark, floor_monday(F.lit("2010-10-10 05:00:00").cast(NTZ))) == dt.datetime(2010, 10, 4)


def test_ordinals(spark):
    days = {1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 22: "22nd", 31: "31st"}
    for day, text in days.items():
        assert one(spark, ordinal_day(F.lit(f"2024-01-{day:02d} 00:00:00").cast(NTZ))) == text


def test_number_texts(spark):
    assert one(spark, cut(F.lit(99.85), F.lit(1))) == "99.8"
    assert one(spark, cut(F.lit(-2.39), F.lit(2))) == "-2.39"
    assert one(spark, cut(F.lit(-0.1), F.lit(2))) == "-0.10"
    assert one(spark, trimmed(F.lit(100.0))) == "100"
    assert one(spark, trimmed(F.lit(0.5))) == "0.5"
    assert one(spark, trimmed(F.lit(0.0))) == "0"
    assert one(spark, clock(F.lit(3725))) == "01:02:05"
