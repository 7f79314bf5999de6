"""Window operators over an area's years.

A panel has one row per (area, year), so a window over one area holds at most as many rows as there are years.
Operators that order areas within a year use ``number_rows`` instead, because a year may hold any number of areas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.operators.joins import PANEL_KEYS, shift_year
from areapanel.operators.missing import known, without_nan
from areapanel.operators.scale import group_lookup, lookup_join, number_rows


def by_area(area: str = "area", year: str = "year"):
    return Window.partitionBy(area).orderBy(year)


def panel_lag(df: DataFrame, value: str, n: int, name: str, mode: str = "row") -> DataFrame:
    """Value ``n`` rows earlier (``row``) or ``n`` calendar years earlier (``calendar``) of the same area."""
    if mode == "row":
        return df.withColumn(name, F.lag(value, n).over(by_area()))
    if mode == "calendar":
        earlier = shift_year(df.select("area", "year", F.col(value).alias(name)), n)
        return df.join(earlier, list(PANEL_KEYS), "left")
    raise ValueError("mode is 'row' or 'calendar'")


def panel_diff(df: DataFrame, value: str, name: str) -> DataFrame:
    df = without_nan(df, [value])
    return df.withColumn(name, F.col(value) - F.lag(value).over(by_area()))


def growth_back(df: DataFrame, value: str, name: str) -> DataFrame:
    """Growth as a share of the current value: 1 - previous / current."""
    df = without_nan(df, [value])
    return df.withColumn(name, F.lit(1.0) - F.try_divide(F.lag(value).over(by_area()), F.col(value)))


def growth_forward(df: DataFrame, value: str, name: str) -> DataFrame:
    """The usual growth: current / previous - 1."""
    df = without_nan(df, [value])
    return df.withColumn(name, F.try_divide(F.col(value), F.lag(value).over(by_area())) - 1)


def growth_overall(df: DataFrame, value: str, name: str) -> DataFrame:
    """(1 - first / last) / years between, over the first and last year with a value; needs two such years."""
    span = df.filter(known(df, value).isNotNull()).groupBy("area").agg(
        F.min_by(value, "year").alias("_first"), F.max_by(value, "year").alias("_last"),
        (F.max("year") - F.min("year")).alias("_years"),
    )
    rate = F.try_divide(F.lit(1.0) - F.try_divide(F.col("_first"), F.col("_last")), F.col("_years"))
    return span.filter("_years > 0").select("area", rate.alias(name)).dropna()


def first_last(df: DataFrame) -> DataFrame:
    """The first and the last row of each area; one row if they are the same."""
    w = by_area()
    back = Window.partitionBy("area").orderBy(F.col("year").desc())
    marked = df.withColumns({"_a": F.row_number().over(w), "_z": F.row_number().over(back)})
    return marked.filter("_a = 1 OR _z = 1").drop("_a", "_z")


def running_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of the known values up to the row's year; NULL before the first of them."""
    w = by_area().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(known(df, value)).over(w))


def cum_increase(df: DataFrame, value: str, name: str, years: int = 10) -> DataFrame:
    """Increase in percent over the first value found in the trailing ``years``; also names that first year."""
    df = without_nan(df, [value])
    w = by_area().rangeBetween(-years, 0)
    base = F.first(value).over(w)
    return df.withColumns({
        name: (F.try_divide(F.col(value), base) - 1) * 100, "frame_start": F.first("year").over(w),
    })


def with_group_stats(df: DataFrame, group: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of a group next to each of its rows, from one aggregate and a lookup.

    Aggregates see NULL where a value is NaN; rows without a key are a group.
    """
    seen = without_nan(df, [c for c in df.columns if c not in set(group)])
    stats = seen.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()])
    return group_lookup(df, stats, list(group), "left")


def deflator(rates: DataFrame, rate: str = "rate", name: str = "factor") -> DataFrame:
    """Factor that brings a year's money to the last year: product of (1 + rate) over the later years.

    One row per year, so one window over all of them is a short list.
    """
    later = Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(1, Window.unboundedFollowing)
    return rates.select("year", F.coalesce(F.product(F.col(rate) + 1).over(later), F.lit(1.0)).alias(name))


def deflate(panel: DataFrame, values: dict[str, str], factors: DataFrame, factor: str = "factor") -> DataFrame:
    """Multiply columns by the year's factor; ``values`` maps column -> new name."""
    joined = lookup_join(panel, factors.select("year", F.col(factor).alias("_f")), ["year"], "left")
    return joined.withColumns({new: F.col(c) * F.col("_f") for c, new in values.items()}).drop("_f")


def forecast_roll(df: DataFrame, base: str, increment: str, name: str) -> DataFrame:
    """mu_t = mu_(t-1) + increment_t from the base value on: the base plus a running sum."""
    w = by_area().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.col(base) + F.sum(increment).over(w))


def compound_forecast(
    df: DataFrame, value: str, growths: dict[str, str], steps: int, year: str = "year"
) -> DataFrame:
    """Follow the value forward for ``steps`` years, rounding each year; ``growths`` maps growth column -> result.

    The steps run inside the row, which then becomes one row per year.
    """
    from areapanel.functions.probability import compound_path

    paths = [compound_path(F.col(value), F.col(g), steps).alias(n) for g, n in growths.items()]
    kept = [c for c in df.columns if c not in {value, year}]
    return (
        df.select(*kept, F.col(year).alias("_y0"), F.posexplode(F.arrays_zip(*paths)).alias("_i", "_p"))
        .select(*kept, (F.col("_y0") + F.col("_i") + 1).cast("int").alias(year),
                *[F.col(f"_p.{n}").alias(n) for n in growths.values()])
    )


def rank_areas(df: DataFrame, value: str, name: str = "rank", year: str = "year", area: str = "area", **kw) -> DataFrame:
    """Rank within the year by falling value, ties by area; rows without a value come last."""
    return number_rows(df, [year], [known(df, value).desc_nulls_last(), F.col(area).asc()], name, **kw)
