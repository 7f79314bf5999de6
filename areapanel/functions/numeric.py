"""Arithmetic on columns, with the rounding and zero rules of the panel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the offset added before the logarithm of a count.
LOG_OFFSET = 1.001


def safe_log(c: Column) -> Column:
    """Natural logarithm; NULL at zero and below."""
    return F.when(c > 0, F.ln(c))


def log_offset(c: Column) -> Column:
    """ln(c + 1.001), the logarithm used on counts."""
    return F.ln(c + F.lit(LOG_OFFSET))


def per_unit(amount: Column, unit: Column) -> Column:
    """Density; NULL where the unit is zero."""
    return F.try_divide(amount.cast("double"), unit.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def cap(c: Column, top: int) -> Column:
    """min(c, top); NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(c, F.lit(top)))


def reverse_scale(c: Column, top: int = 10) -> Column:
    """1..top turned around to top..1, after capping."""
    return F.lit(top + 1) - cap(c, top)


def flag_at_least(c: Column, bound: int, yes: str = "red", no: str = "grey") -> Column:
    return F.when(c >= bound, yes).otherwise(no)


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def geo_key(lat: Column, lon: Column, digits: int = 4) -> tuple[Column, Column]:
    """Coordinates rounded to a fixed number of decimals, as text keys."""
    return F.round(lat, digits).cast("string"), F.round(lon, digits).cast("string")


def grid_key(c: Column, digits: int = 4) -> Column:
    """The rounded coordinate as a whole number, for joins."""
    return F.round(c * 10**digits).cast("bigint")


def annualize(value: Column, year: Column, partial_year: int, factor: float = 1 + 1 / 12) -> Column:
    """Scale the counts of a year that is not over yet, rounding half to even; other years stay."""
    return F.when(year == partial_year, F.bround(value * F.lit(factor))).otherwise(value.cast("double"))


def interpolate(low: Column, high: Column, share: Column) -> Column:
    return low + (high - low) * share
