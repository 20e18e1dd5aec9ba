"""Exact arithmetic on built-in expressions.

Quotients of counters are rounded half away from zero in 64-bit integers, which gives the decimal
answer without decimals and stays inside generated code. ``NULL`` and zero divisors give ``NULL``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """Integer division truncating toward zero."""
    return F.call_function("div", a, b)


def ratio_units(num: Column, den: Column, units: int) -> Column:
    """``num / den`` in whole ``1/units`` steps, half away from zero, as a long.

    The quotient and the remainder are scaled apart, so ``num`` may use the full 64-bit range while
    ``den`` stays below ``2**62 / units``. One guard covers a zero divisor, and half a step is added
    with the sign of ``num`` before a division that truncates: short code, for plans with hundreds of
    such columns.
    """
    n, d = num.cast("long"), den.cast("long")
    half = F.when(n < 0, -F.abs(d)).otherwise(F.abs(d))
    part = div((n % d) * F.lit(2 * units) + half, d * F.lit(2))
    return F.when(d != 0, div(n, d) * F.lit(units) + part)


def ratio_text(num: str, den: str, units: int) -> str:
    """``ratio_units`` as SQL text. Wide plans are built from text: one parse instead of a call per node."""
    return (
        f"CASE WHEN ({den}) <> 0 THEN (({num}) div ({den})) * {units} + ((({num}) % ({den})) * {2 * units} + "
        f"CASE WHEN ({num}) < 0 THEN -abs({den}) ELSE abs({den}) END) div (({den}) * 2) END"
    )


def round_text(num: str, den: str, digits: int, times: int = 1) -> str:
    """``ROUND(times * num / den, digits)`` as SQL text."""
    return f"(({ratio_text(num, den, times * 10**digits)}) / {10**digits})"


def rate_text(diff: str, seconds: str) -> str:
    """Change per second with two digits, as SQL text."""
    return round_text(diff, seconds, 2)


def percent_text(part: str, whole: str, digits: int = 1) -> str:
    return round_text(part, whole, digits, times=100)


def units_text(value: str, digits: int) -> str:
    """A value with at most ``digits`` decimals as a whole number of its last place."""
    return f"CAST(floor(({value}) * {10**digits} + 0.5D) AS BIGINT)"


def mean_text(value: str, digits: int) -> str:
    """Average that does not depend on the order of summation: the sum is taken in whole units."""
    return f"(sum({units_text(value, digits)}) / count({value}) / {float(10**digits)}D)"


def round_ratio(num: Column, den: Column, digits: int, times: int = 1) -> Column:
    """``ROUND(times * num / den, digits)`` as a double."""
    return ratio_units(num, den, times * 10**digits) / F.lit(10**digits)


def _guard(cols: tuple[Column, ...], answer: Column) -> Column:
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    return F.when(~missing, answer)


def strict_least(*cols: Column) -> Column:
    """Smallest value, NULL when any argument is NULL."""
    return _guard(cols, F.least(*cols))


def strict_greatest(*cols: Column) -> Column:
    """Largest value, NULL when any argument is NULL."""
    return _guard(cols, F.greatest(*cols))


def round_digits(lowest: Column, highest: Column) -> Column:
    """Digits worth printing for a series that spans ``lowest..highest``; at least one."""
    span = F.nullif((highest - lowest).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(1), F.coalesce(F.ceil(-F.ln(span)).cast("int"), F.lit(0)))
