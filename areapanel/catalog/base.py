"""Registry and the tables the queries share.

Stand-ins: area = nation, borough = region, year = year of the order, category = order priority or ship year,
event = order or line item, price and income of an area-year = mean order value and mean balance of its buyers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a callable under its own name; ``covers`` lists operator ids."""
    def add(fn):
        key = name or fn.__name__
        if key in CATALOG:
            raise ValueError(f"query {key} is registered twice")
        CATALOG[key] = Query(key, tuple(covers.split()), fn, sql.strip() if sql else None)
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)


def order_totals(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Orders summed per customer, year (and extra columns): what a hot customer contributes is one row per task."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return o.groupBy(F.col("o_custkey").alias("c_custkey"), "year", *extra).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


def customer_areas(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("area"), "c_acctbal")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(area, year, category, count)"""
    joined = order_totals(spark, sf, "o_orderpriority").join(customer_areas(spark, sf), "c_custkey")
    return joined.groupBy("area", "year", F.col("o_orderpriority").alias("category")).agg(F.sum("n").alias("count"))


CATEGORY_CTE = """counts AS (
  SELECT c_nationkey AS area, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category,
         count(*) AS count
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(area, year, n, price, income). Sums are decimal, so the order of the rows does not matter."""
    joined = order_totals(spark, sf).join(customer_areas(spark, sf), "c_custkey")
    balance = F.col("c_acctbal").cast("decimal(12,2)") * F.col("n")
    sums = joined.groupBy("area", "year").agg(
        F.sum("n").alias("n"), F.sum("total").alias("_t"), F.sum(balance.cast("decimal(22,2)")).alias("_b"))
    return sums.select(
        "area", "year", "n", (F.col("_t").cast("double") / F.col("n")).alias("price"),
        (F.col("_b").cast("double") / F.col("n")).alias("income"))


PANEL_CTE = """panel AS (
  SELECT c_nationkey AS area, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price,
         CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS income
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def wide_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(area, year, A1, A2, DM, NB, land): priorities in the role of permit types; the last two are both NB.

    ``land`` is a size of the area, derived from its name.
    """
    from areapanel.operators.aggregates import sums_by_category

    counts = category_counts(spark, sf)
    mapped = counts.replace(dict(zip(PRIORITIES, ("A1", "A2", "DM", "NB", "NB"))), subset=["category"])
    wide = sums_by_category(mapped, ["area", "year"], "category", "count", ["A1", "A2", "DM", "NB"])
    return wide.join(areas(spark, sf).select("area", "land"), "area")


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """(area, borough, name, land, adjacent): fixed attributes of the areas."""
    k = F.col("n_nationkey")
    near = F.array((k + 24) % 25, (k + 1) % 25, (k + 5) % 25)
    return table(spark, sf, "nation").select(
        k.alias("area"), F.col("n_regionkey").alias("borough"), F.col("n_name").alias("name"),
        (F.lit(1.0) + k / 10).alias("land"), F.array_join(near.cast("array<string>"), ", ").alias("adjacent"))


AREAS_CTE = """areas AS (
  SELECT n_nationkey AS area, n_regionkey AS borough, n_name AS name, 1.0::DOUBLE + n_nationkey / 10.0::DOUBLE AS land,
         ((n_nationkey + 24) % 25)::VARCHAR || ', ' || ((n_nationkey + 1) % 25)::VARCHAR || ', '
         || ((n_nationkey + 5) % 25)::VARCHAR AS adjacent
  FROM nation)"""

WIDE_CTE = CATEGORY_CTE + """, wide AS (
  SELECT c.area, c.year,
         CAST(sum(CASE WHEN category = '1-URGENT' THEN count ELSE 0 END) AS BIGINT) AS A1,
         CAST(sum(CASE WHEN category = '2-HIGH' THEN count ELSE 0 END) AS BIGINT) AS A2,
         CAST(sum(CASE WHEN category = '3-MEDIUM' THEN count ELSE 0 END) AS BIGINT) AS DM,
         CAST(sum(CASE WHEN category IN ('4-NOT SPECIFIED', '5-LOW') THEN count ELSE 0 END) AS BIGINT) AS NB,
         1.0::DOUBLE + c.area / 10.0::DOUBLE AS land
  FROM counts c GROUP BY c.area, c.year)"""


def rounded(digits: int, *cols: str) -> dict:
    return {c: F.round(c, digits) for c in cols}
