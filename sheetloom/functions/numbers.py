"""Number reading and number text with the rounding of IEEE decimal printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def to_number(text: Column) -> Column:
    """Double value of a plain or exponent number, or null for any other text."""
    return F.when(text.rlike(_FLOAT), F.trim(text).try_cast("double"))


def number_or(text: Column, default: float) -> Column:
    """``to_number`` with a default for unreadable text."""
    return F.coalesce(to_number(text), F.lit(default))


def thousandths(v: Column) -> Column:
    """The value rounded to thousandths, half to even by the exact binary value, for ``thousandths_text``.

    The product by 1000 decides unless it is rounded to a tie. Then it is split into an exact
    high and low part, so that the side of the tie is known. ``v`` is used several times, so it
    should be a variable of a lambda.
    """
    a = F.abs(v)
    product = a * 1000.0
    below = F.floor(product)
    wide = a * 134217729.0
    high = wide - (wide - a)
    rest = (high * 1000.0 - product) + (a - high) * 1000.0
    up = F.when(rest > 0, F.lit(1)).when(rest < 0, F.lit(0)).otherwise(below % 2)
    whole = F.when(product - below == 0.5, below + up).otherwise(F.rint(product).cast("bigint"))
    # Only a zero needs its text to tell the sign.
    sign = F.when(v < 0, "-").when((v == 0) & F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
    # From 2**43 on values carry no tie at three decimals, and infinities print as words.
    small = a < 8796093022208.0
    return F.struct(sign.alias("sign"), F.when(small, whole).alias("whole"), F.when(~small, v).alias("large"))


def thousandths_text(t: Column) -> Column:
    """Text with three decimals of what ``thousandths`` gives."""
    whole = t["whole"]
    # Whole part and decimals are numbers, so that no pattern is searched in their text.
    text = F.concat(t["sign"], F.call_function("div", whole, F.lit(1000)).cast("string"), F.lit("."), F.substr((whole % 1000 + 1000).cast("string"), F.lit(2)))
    return F.coalesce(text, F.when(t["large"].isNotNull(), F.format_string("%.3f", t["large"])))


def all_fixed3(values: Column) -> Column:
    """``fixed3`` of an array; the rounded number is a variable, so it is computed once."""
    return F.transform(F.transform(values, thousandths), thousandths_text)


def fixed3(v: Column) -> Column:
    """Text with three decimals, rounding the exact binary value half to even."""
    return F.get(all_fixed3(F.array(v)), 0)


def float_text(v: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, exponent form outside."""
    java = v.cast("string")
    a = F.abs(v)
    plain = F.regexp_replace(
        F.regexp_replace(java.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(java, F.lit("E"), F.lit(2))
    digits = F.regexp_replace(power, "^-", "")
    digits = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    exponent = F.concat(
        mantissa, F.lit("e"), F.when(F.startswith(power, F.lit("-")), "-").otherwise("+"), digits
    )
    return (
        F.when(~F.contains(java, F.lit("E")), java)
        .when((a >= 1e-4) & (a < 1e16), plain)
        .otherwise(exponent)
    )
