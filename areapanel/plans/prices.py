"""Wide monthly price series -> one price index per area and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.operators.aggregates import avg_by, yearly_mean
from areapanel.operators.filters import not_value
from areapanel.operators.reshape import normalize_by_base, normalize_by_group_max, unpivot_periods

# Id columns of the wide sheet, the series left out and the base month all series have.
ID_COLUMNS = ("Dataset", "RegionName", "City", "State", "Metro", "CountyName", "SizeRank")
LEFT_OUT = "Median Sale Price per sqft"
BASE_MONTH = "2016-08"


def long_prices(wide: DataFrame, ids: Sequence[str] = ID_COLUMNS, leave_out: str | None = LEFT_OUT) -> DataFrame:
    """(dataset, area, month, value) from one column per month."""
    if leave_out is not None:
        wide = not_value(wide, "Dataset", leave_out)
    return unpivot_periods(wide, ids).select(
        F.col("Dataset").alias("dataset"), F.col("RegionName").alias("area"), "month", "value")


def price_index(long: DataFrame, scale: str = "group", base: str = BASE_MONTH) -> DataFrame:
    """(area, year, index): series scaled by their base month, averaged over the series of an area per month, then
    over the months of a year.

    ``group`` scales by the largest base-month value of the dataset, ``own`` by the series' own.
    """
    if scale == "group":
        scaled = normalize_by_group_max(long, "dataset", "month", base, "value")
    elif scale == "own":
        scaled = normalize_by_base(long, ["dataset", "area"], "month", base, "value")
    else:
        raise ValueError("scale is 'group' or 'own'")
    monthly = avg_by(scaled, ["area", "month"], "value_norm", "value")
    return yearly_mean(monthly, "area", "month", "value", "index")
