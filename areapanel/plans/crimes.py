"""Event points -> areas -> yearly counts and map extents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.functions.clean import year_prefix
from areapanel.functions.numeric import geo_key
from areapanel.operators.aggregates import bbox, count_by
from areapanel.operators.filters import semi_filter
from areapanel.operators.joins import enrich_distinct

# Offence names of the counted categories.
VIOLENT_OFFENCES = (
    "MURDER & NON-NEGL. MANSLAUGHTER",
    "HOMICIDE-NEGLIGENT-VEHICLE",
    "HOMICIDE-NEGLIGENT,UNCLASSIFIE",
    "RAPE",
    "ROBBERY",
    "FELONY ASSAULT",
    "BURGLARY",
    "GRAND LARCENY",
    "GRAND LARCENY OF MOTOR VEHICLE",
    "ARSON",
    "DANGEROUS DRUGS",
    "DANGEROUS WEAPONS",
    "KIDNAPPING & RELATED OFFENSES",
    "KIDNAPPING AND RELATED OFFENSES",
    "KIDNAPPING",
    "NYS LAWS-UNCLASSIFIED FELONY",
    "ASSAULT 3 & RELATED OFFENSES",
)
FIRST_YEAR = 2006


def violent_events(
    events: DataFrame, codes: DataFrame, code: str = "code", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Events of the listed codes that have a place, with the place rounded to text keys."""
    placed = events.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    lat_key, lon_key = geo_key(F.col(lat), F.col(lon))
    return semi_filter(placed, codes, code).withColumns({"lat_key": lat_key, "lon_key": lon_key})


def with_area(events: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Resolve each distinct place once; events without a result are left out."""
    return enrich_distinct(events, ["lat_key", "lon_key"], resolve, "inner")


def with_year(events: DataFrame, day: str, first_year: int = FIRST_YEAR) -> DataFrame:
    """Year from the text date, malformed dates included; earlier years and missing dates are left out."""
    return events.withColumn("year", year_prefix(F.col(day))).filter(F.col("year") >= first_year)


def crime_points(events: DataFrame, lat: str = "lat_key", lon: str = "lon_key") -> DataFrame:
    """Events per year, place and area."""
    return count_by(events, ["year", lat, lon, "area"], "crime_count")


def crime_yearly(events: DataFrame) -> DataFrame:
    return count_by(events, ["area", "year"], "crime_count")


def extents(points: DataFrame, x: str, y: str, years: Sequence[int] | None = None) -> DataFrame:
    return bbox(points, "area", x, y, years)
