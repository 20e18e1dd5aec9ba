"""Number texts and ordered joins of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """A number with exactly ``digits`` decimals."""
    if digits == 0:
        return value.cast("long").cast("string")
    return value.cast(f"decimal(24,{digits})").cast("string")


def _plain(value: Column, digits: int) -> Column:
    """Decimal text with ``digits`` decimals; numbers too large for them (from 10^32 on with six) keep zeros there."""
    whole = F.coalesce(value.try_cast("decimal(38,0)").cast("string"), value.cast("string"))
    return F.coalesce(value.try_cast(f"decimal(38,{digits})").cast("string"), F.concat(whole, F.lit("." + "0" * digits)))


def trimmed(value: Column) -> Column:
    """A number with up to six decimals and no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(_plain(value, 6), "0+$", ""), "\\.$", "")


def shortest(value: Column) -> Column:
    """A double in scientific form with the fewest digits, from fifteen on, that are read as the same double again.

    Casting to text may give digits beyond these, which are not those another engine shows. Where two texts of sixteen
    digits are read as the same double (integers over 2^53), it is the one that the longer text rounds to.
    """
    forms = [F.format_string(f"%.{n}e", value) for n in (14, 15, 16)]
    text = forms[-1]
    for form in forms[-2::-1]:
        text = F.when(form.try_cast("double") == value, form).otherwise(text)
    return text


def positional(value: Column) -> tuple[Column, Column, Column]:
    """Sign, whole digits and decimals of a double, the exponent moved out; all digits that tell it from its neighbours."""
    text = shortest(F.abs(value.cast("double")))
    mantissa = F.substring_index(text, "e", 1)
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    point = 1 + F.when(F.contains(text, F.lit("e")), F.substring_index(text, "e", -1).try_cast("int"))  # NULL unless finite
    whole = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0")))
    decimals = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(
        F.substring(digits, point + 1, F.length(digits)))
    return F.when(value < 0, "-").otherwise(""), whole, decimals


def cut(value: Column, digits: Column) -> Column:
    """Decimal text cut, never rounded, after ``digits`` decimals; missing decimals are zeros. NULL unless finite."""
    sign, whole, decimals = positional(value)
    return F.concat(sign, whole, F.lit("."), F.rpad(F.substring(decimals, F.lit(1), digits), digits, F.lit("0")))


def plus_spaces(value: Column) -> Column:
    """Spaces as plus signs, the form used inside a payload."""
    return F.replace(value, F.lit(" "), F.lit("+"))


def joined(value: Column, separator: str, *order: Column) -> Column:
    """Ordered string aggregation that skips NULL, for groups of bounded size."""
    keys = [*order, value]
    packed = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))))
    last = f"k{len(keys) - 1}"
    return F.when(F.count(value) > 0, F.array_join(F.transform(packed, lambda s: s[last]), separator))
