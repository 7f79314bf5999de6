"""Permit filings -> yearly counts per area and type -> panel columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.functions.clean import to_year
from areapanel.functions.numeric import annualize, log_offset, per_unit
from areapanel.operators.aggregates import count_by, min_by_key, rate_by
from areapanel.operators.filters import first_versions
from areapanel.operators.joins import complete_grid, enrich
from areapanel.operators.panel import by_area
from areapanel.operators.reshape import pivot_counts
from areapanel.operators.scale import materialize

# Permit types counted, and the format of filing dates.
JOB_TYPES = ("A1", "A2", "DM", "NB")
FILING_FORMAT = "MM/dd/yyyy"


def permit_counts(
    filings: DataFrame, areas: DataFrame, job: str = "job", doc: str = "doc", kind: str = "job_type",
    filed: str = "filing_date", fmt: str = FILING_FORMAT, types: Sequence[str] = JOB_TYPES,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """(area, year, job_type, count) over the full grid of known areas, years seen and types.

    A job counts once, in the year it was first filed. Areas outside ``areas`` are left out by the semi-join inside
    the grid.
    """
    first = first_versions(filings, doc, F.col(kind).isin(list(types)))
    dated = first.select("area", F.col(job).alias("job"), F.col(kind).alias("job_type"), to_year(F.col(filed), fmt).alias("year"))
    jobs = min_by_key(dated.filter(F.col("year").isNotNull()), ["job", "job_type", "area"], "year", "year")
    # Written out once: the years seen and the grid both start from the counts, not from the filings.
    counts = materialize(count_by(jobs, ["area", "year", "job_type"]))
    if years is None:
        years = counts.join(areas.select("area").distinct(), "area", "left_semi")
    return complete_grid(counts, areas, {"year": years, "job_type": list(types)})


def add_permit_columns(panel: DataFrame, counts: DataFrame, types: Sequence[str] = JOB_TYPES) -> DataFrame:
    """Permit counts as panel columns; the panel keeps its rows."""
    wide = pivot_counts(counts, ["area", "year"], "job_type", list(types), "count")
    return enrich(panel.drop(*types), wide, expect_unique=True)


def permit_lags(panel: DataFrame, land: str = "land") -> DataFrame:
    """Logarithms of earlier permit counts: one year back, demolitions per square mile two years back."""
    w = by_area()
    return panel.withColumns({
        "nb_lag1": log_offset(F.lag("NB", 1).over(w)),
        "a1_lag1": log_offset(F.lag("A1", 1).over(w)),
        "a2_lag1": log_offset(F.lag("A2", 1).over(w)),
        "dm_lag1": log_offset(F.lag(per_unit(F.col("DM"), F.col(land)), 1).over(w)),
        "dm_lag2": log_offset(F.lag(per_unit(F.col("DM"), F.col(land)), 2).over(w)),
    })


def permit_rates(
    wide: DataFrame, partial_year: int, first_year: int, types: Sequence[str] = JOB_TYPES, periods: int = 8
) -> DataFrame:
    """Mean, deviation and yearly rate per area since ``first_year``, the partial year scaled up."""
    full = wide.filter(F.col("year") >= first_year).withColumns(
        {t: annualize(F.col(t), F.col("year"), partial_year) for t in types})
    return rate_by(full, "area", list(types), periods)


def permit_points(filings: DataFrame, lat: str, lon: str, kind: str = "job_type") -> DataFrame:
    """Permits per year, type, area and point."""
    return count_by(filings, ["year", kind, "area", lat, lon], "num_permits")
