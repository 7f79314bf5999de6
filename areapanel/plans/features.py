"""Inflation adjustment, neighbour averages and distance to the best areas, as panel columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapanel.operators.joins import neighbor_avg
from areapanel.operators.nearest import proximity_to_top
from areapanel.operators.panel import deflate, deflator
from areapanel.operators.scale import materialize

# Yearly change of consumer prices, public statistics, first entry 2002.
CPI_FIRST_YEAR = 2002
CPI_CHANGE = (0.016, 0.023, 0.027, 0.034, 0.032, 0.028, 0.038, -0.004, 0.016, 0.032, 0.021, 0.015, 0.016, 0.001)


def cpi_factors(spark: SparkSession) -> DataFrame:
    """(year, factor): the factor that brings a year's money to the last year of the table.

    The year before the first change is part of the table, since its money passes through all changes.
    """
    rows = [(CPI_FIRST_YEAR - 1, 0.0)] + [(CPI_FIRST_YEAR + i, r) for i, r in enumerate(CPI_CHANGE)]
    return deflator(spark.createDataFrame(rows, "year int, rate double"))


def add_features(
    panel: DataFrame, adjacency: DataFrame, factors: DataFrame, income: str = "income", price: str = "price",
    x: str = "x", y: str = "y",
) -> DataFrame:
    """Adjusted income and price, their neighbour averages, and the distance to the year's top areas by income."""
    adjusted = deflate(panel, {income: "income_adj", price: "price_adj"}, factors)
    near = neighbor_avg(adjusted, adjacency, {"income_adj": "adjacent_income", "price_adj": "adjacent_price"})
    return proximity_to_top(materialize(near), "income_adj", x, y)


def income_features(df: DataFrame) -> DataFrame:
    """Share of a median in the mean, and density of shops or permits, as used for the scatter plots."""
    return df.withColumns({
        "adjacent_ratio": F.try_divide(F.col("income_adj"), F.col("adjacent_income")),
        "price_per_income": F.try_divide(F.col("price_adj"), F.col("income_adj")),
    })
