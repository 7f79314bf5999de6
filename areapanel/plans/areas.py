"""Results per area: labels, reasons, probabilities, rankings, series and map slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.functions.clean import map_labels
from areapanel.functions.numeric import cap, flag_at_least, reverse_scale
from areapanel.functions.probability import gamma_tail
from areapanel.operators.aggregates import sums_by_category
from areapanel.operators.distribution import quantile_by
from areapanel.operators.joins import PANEL_KEYS, enrich, shift_year
from areapanel.operators.missing import known
from areapanel.operators.panel import cum_increase, rank_areas
from areapanel.operators.scale import lookup_join, materialize

# Span of the analysis, last year with actual income, percentiles, reason texts and colours.
SPAN, LAST_ACTUAL_YEAR, LOW_P, TOP_P = 10, 2015, 0.4, 2 / 3
ELIGIBLE, PAST, HIGH, LOW_INCREASE = "N/A", "Past", "High Income and/or Housing", "Low Increase Rate"
CLASS_COLORS = {"gent": "#1565C0", "no_low": "#4CAF50", "no_mid": "#FBC02D", "no_high": "#424242"}
ICON_COLORS = {"gent": "blue", "no_low": "green", "no_mid": "orange", "no_high": "lightgray"}
NO_CLASS_COLOR, NO_ICON_COLOR = "gray", "black"


def year_bands(panel: DataFrame, low: float = LOW_P, top: float = TOP_P, **kw) -> DataFrame:
    """(year, income_low, income_high, house_low, house_high): percentiles of all areas of a year.

    Both columns are ranked in one pass over a long form.
    """
    long = panel.select("year", "income", "price").unpivot(["year"], ["income", "price"], "measure", "value")
    q = quantile_by(long, ["year", "measure"], "value", {"low": low, "high": top}, **kw)
    def pick(measure, col):
        return F.max(F.when(F.col("measure") == measure, F.col(col)))
    return q.groupBy("year").agg(
        pick("income", "low").alias("income_low"), pick("income", "high").alias("income_high"),
        pick("price", "low").alias("house_low"), pick("price", "high").alias("house_high"),
    )


def reason(eligible: Column, risen: Column, year: Column, last_actual_year: int = LAST_ACTUAL_YEAR) -> Column:
    """Why an area has no probability; the first rule that applies."""
    return (
        F.when(year <= last_actual_year, PAST).when(~eligible, HIGH).when(~risen, LOW_INCREASE).otherwise(ELIGIBLE)
    )


def area_class(eligible: Column, risen: Column, price: Column, house_low: Column, house_high: Column) -> Column:
    """gent, or not gent with a low, middle or high house value."""
    return (
        F.when(eligible & risen, "gent").when(price < house_low, "no_low").when(price < house_high, "no_mid")
        .otherwise("no_high")
    )


def label_areas(
    panel: DataFrame, span: int = SPAN, low: float = LOW_P, top: float = TOP_P, last_actual_year: int = LAST_ACTUAL_YEAR,
    **kw,
) -> DataFrame:
    """One row per area and year that has a row ``span`` years earlier.

    Eligible: income and house value at the start both below the start year's low percentile. Risen: the house
    value's increase exceeds the year's top percentile of increases. Also the house value it takes to rise so much.
    """
    panel = materialize(panel.select("area", "year", "income", "price"))
    bands = year_bands(panel, low, top, **kw)
    start = shift_year(panel.select(
        "area", "year", F.col("income").alias("income_start"), F.col("price").alias("price_start")), span)
    start_bands = shift_year(bands, span)
    rows = panel.select("area", "year", "price").join(start, list(PANEL_KEYS))
    rows = lookup_join(rows, start_bands, ["year"], "inner")
    rows = materialize(rows.withColumn("increase", F.try_divide(F.col("price"), F.col("price_start")) - 1))
    tops = quantile_by(rows, ["year"], "increase", {"top_increase": top}, **kw)
    rows = lookup_join(rows, tops, ["year"], "left")
    eligible = (F.col("income_start") < F.col("income_low")) & (F.col("price_start") < F.col("house_low"))
    risen = F.col("increase") > F.col("top_increase")
    return rows.withColumns({
        "eligible": eligible, "risen": risen, "threshold": F.col("price_start") * (F.col("top_increase") + 1),
        "reason": reason(eligible, risen, F.col("year"), last_actual_year),
        "class": area_class(eligible, risen, F.col("price_start"), F.col("house_low"), F.col("house_high")),
    })


def area_probability(df: DataFrame, name: str = "probability") -> DataFrame:
    """Tail probability above the threshold for eligible rows, 0 otherwise; needs threshold, alpha, beta, reason."""
    tail = gamma_tail(F.col("threshold"), F.col("alpha"), F.col("beta"))
    return df.withColumn(name, F.when(F.col("reason") == ELIGIBLE, tail).otherwise(F.lit(0.0)))


def with_colors(df: DataFrame, col: str = "class") -> DataFrame:
    return df.withColumns({
        "color": map_labels(F.col(col), CLASS_COLORS, NO_CLASS_COLOR),
        "icon_color": map_labels(F.col(col), ICON_COLORS, NO_ICON_COLOR),
    })


def ranking(df: DataFrame, year: int, value: str = "probability", index: str = "price", **kw) -> DataFrame:
    """Areas of a year by falling probability: percent rounded half to even, index to four digits."""
    ranked = rank_areas(df.filter(F.col("year") == year), value, **kw)
    return ranked.withColumns({
        "percent": F.bround(F.col(value) * 100).cast("int"), "index": F.bround(index, 4)})


def area_series(panel: DataFrame, bands: DataFrame, area, year: int, last_actual_year: int = LAST_ACTUAL_YEAR) -> DataFrame:
    """Index and income of one area with the year's bands up to ``year``; income only while it is actual."""
    own = panel.filter((F.col("area") == area) & (F.col("year") <= year)).select("area", "year", "income", "price")
    joined = lookup_join(own, bands, ["year"], "left")
    actual = F.col("year") <= last_actual_year
    return joined.withColumns({c: F.when(actual, F.col(c)) for c in ("income", "income_low", "income_high")})


def increase_series(panel: DataFrame, area, year: int, span: int = SPAN) -> DataFrame:
    """Accumulated increase in percent over the first row found in the ``span`` years up to ``year``."""
    frame = panel.filter((F.col("area") == area) & F.col("year").between(year - span, year))
    return cum_increase(frame.select("area", "year", "price"), "price", "increase", span)


def crime_slice(points: DataFrame, extents: DataFrame, area, year: int, count: str = "crime_count") -> DataFrame:
    """Points of an area and year with size, colour, the area's total and its extent.

    The total is one aggregate row of the same filtered points, read as a scalar.
    """
    own = points.filter((F.col("area") == area) & (F.col("year") == year))
    total = own.agg(F.sum(count).alias("total")).scalar()
    return enrich(own.withColumns({
        "size": F.col(count) / 10, "flag": flag_at_least(F.col(count), 10), "total": total,
    }), extents, ["area"])


def permit_slice(points: DataFrame, area, year: int, count: str = "num_permits") -> DataFrame:
    """Points of an area and year with capped intensity and its reverse."""
    own = points.filter((F.col("area") == area) & (F.col("year") == year))
    return own.withColumns({"intensity": cap(F.col(count), 10), "reverse": reverse_scale(F.col(count), 10)})


def permit_totals(points: DataFrame, types: Sequence[str], count: str = "num_permits", kind: str = "job_type") -> DataFrame:
    """One column per type and area-year."""
    return sums_by_category(points, ["area", "year"], kind, count, types)


def area_profile(area, names: DataFrame, features: DataFrame, places: DataFrame) -> DataFrame:
    """Name, description, features and place of one area."""
    own = names.filter(F.col("area") == area)
    return own.join(features.filter(F.col("area") == area), "area", "left").join(
        places.filter(F.col("area") == area), "area", "left")


def top_area(df: DataFrame, year: int, value: str = "probability") -> DataFrame:
    """The default selection: the highest value of the year, ties to the smallest area."""
    return df.filter(F.col("year") == year).orderBy(known(df, value).desc_nulls_last(), "area").limit(1).select("area")
