"""Inspection records -> shops per area and year, all and newly opened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.operators.aggregates import dedupe_first
from areapanel.operators.filters import not_value

# The placeholder date, the cuisine counted and the inspection type of an opening.
NO_DATE = "1900-01-01"
COFFEE = "Café/Coffee/Tea"
OPENING = "Pre-permit (Operational) / Initial Inspection"


def first_inspections(
    inspections: DataFrame, order: Sequence[Column], shop: str = "shop", day: str = "day"
) -> DataFrame:
    """The first record of each shop's first day; placeholder dates do not count.

    One record per shop and day and then the earliest day is the first row by day and ``order``, so one window with
    a limit does both.
    """
    dated = not_value(inspections, day, NO_DATE).dropna("any", subset=[shop, day])
    first = dedupe_first(dated, [shop], [F.col(day).asc(), *order])
    return first.withColumn("year", F.year(F.col(day).cast("date")))


def shop_counts(
    first: DataFrame, years: Sequence[int], cuisine: str = COFFEE, opening: str | None = None,
    cumulative: bool = True, name: str = "name", kind: str = "cuisine", inspection: str = "inspection",
) -> DataFrame:
    """Shops per area, one column per year.

    Each shop has one first day, so it is counted once; cumulative columns add up the years before. With
    ``opening`` only shops whose first inspection is of that type count.
    """
    rows = first.filter(F.col(kind) == cuisine).dropna("any", subset=["area", name])
    if opening is not None:
        rows = rows.filter(F.col(inspection) == opening)
    in_range = F.col("year").isin(list(years))
    ordered = sorted(years)
    columns = []
    for y in ordered:
        counted = (F.col("year") <= y) if cumulative else (F.col("year") == y)
        columns.append(F.sum(F.when(counted & in_range, 1).otherwise(0)).alias(str(y)))
    return rows.groupBy("area").agg(*columns)


def shop_counts_long(first: DataFrame, cuisine: str = COFFEE, kind: str = "cuisine", name: str = "name") -> DataFrame:
    """(area, year, opened, total): the same in long form, for the years an area has shops in."""
    rows = first.filter(F.col(kind) == cuisine).dropna("any", subset=["area", name])
    yearly = rows.groupBy("area", "year").agg(F.count(F.lit(1)).alias("opened"))
    w = Window.partitionBy("area").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return yearly.withColumn("total", F.sum("opened").over(w))
