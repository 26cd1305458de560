"""Exact money between decimal text and integer minor units."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 100_000_000

#: The usual spelling, which is its minor units with a point inside; at most 18 digits fit BIGINT.
PLAIN_PATTERN = r"^[0-9]{1,10}\.[0-9]{8}\z"
#: Decimal text: sign, digits with an optional point, optional exponent.
DECIMAL_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_minor_units(text: Column) -> Column:
    """Decimal text to minor units, or null when it is no number or finer than one unit.

    The text is read as DECIMAL(38,18) and must equal itself at eight decimals. Nonzero digits
    past the eighteenth decimal are rejected by pattern first, because the cast rounds them
    away. Values beyond BIGINT are rejected. The usual spelling is read as a whole number.
    """
    usual = F.replace(text, F.lit("."), F.lit("")).try_cast("bigint")
    return F.when(text.rlike(PLAIN_PATTERN), usual).otherwise(_from_decimal(text))


def _from_decimal(text: Column) -> Column:
    plain = F.regexp_replace(text, "_", "")
    value = plain.try_cast("decimal(38,18)")
    vanished = plain.rlike("[eE]-") & (value == 0) & plain.rlike("^[^eE]*[1-9]")
    lost = plain.rlike(r"\.[0-9]{18}[0-9]*[1-9]") | vanished
    rounded = value.try_cast("decimal(28,8)")
    units = (rounded * F.lit(UNIT).cast("decimal(9,0)")).try_cast("bigint")
    return F.when(plain.rlike(DECIMAL_PATTERN) & ~lost & (value == rounded), units)


def from_minor_units(units: Column) -> Column:
    """Minor units as plain text with eight decimals."""
    size = F.abs(units)
    unit = F.lit(UNIT).cast("bigint")
    whole = ((size - size % unit) / unit).cast("bigint")
    return F.concat(
        F.when(units < 0, F.lit("-")).otherwise(F.lit("")),
        whole.cast("string"), F.lit("."), F.lpad((size % unit).cast("string"), 8, "0"))
