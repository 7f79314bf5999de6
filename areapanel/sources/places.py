"""Results of place look-ups, stored as JSON text, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapanel.functions.clean import extract_zip, first_match
from areapanel.functions.text import first_paragraph
from areapanel.sources.schemas import PLACE_PAGE


def flatten_places(df: DataFrame, json_col: str) -> DataFrame:
    """One row per place of every page whose status is OK, next to the page's other columns."""
    kept = [c for c in df.columns if c != json_col]
    parsed = df.withColumn("_page", F.from_json(json_col, PLACE_PAGE)).filter(F.col("_page.status") == "OK")
    rows = parsed.select(*kept, F.explode("_page.results").alias("_r"))
    return rows.select(
        *kept, F.col("_r.place_id").alias("place_id"), F.col("_r.formatted_address").alias("address"),
        F.col("_r.name").alias("name"), F.col("_r.types").alias("types"),
        F.col("_r.geometry.location.lat").alias("lat"), F.col("_r.geometry.location.lng").alias("lon"),
    )


def merge_pages(places: DataFrame, key: str = "place_id", page: str = "page") -> DataFrame:
    """One row per place; the latest page wins."""
    w = Window.partitionBy(key).orderBy(F.col(page).desc())
    return places.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def zip_of_results(df: DataFrame, json_col: str, name: str = "zip") -> DataFrame:
    """Postal code of the first result whose address holds one."""
    parsed = F.from_json(json_col, PLACE_PAGE)
    return df.withColumn(name, first_match(parsed["results"], lambda r: extract_zip(r["formatted_address"])))


def describe_pages(pages: DataFrame, html_col: str, name: str = "description") -> DataFrame:
    return pages.withColumn(name, first_paragraph(F.col(html_col)))
