"""Row filters that differ from a plain ``filter`` in their treatment of NULLs or of other tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.operators.scale import lookup_join


def not_value(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose ``col`` is not ``value``; rows without a value stay."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def semi_filter(df: DataFrame, codes: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``codes``, however often it occurs there."""
    keys = [key] if isinstance(key, str) else list(key)
    return lookup_join(df, codes.select(*keys).distinct(), keys, "left_semi")


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a NULL (or NaN) in ``cols``, all columns by default."""
    return df.dropna("any", subset=list(cols) if cols else None)


def unresolved(df: DataFrame, col: str) -> DataFrame:
    """Rows that still lack ``col``."""
    return df.filter(F.col(col).isNull())


def between_years(df: DataFrame, first: int | None = None, last: int | None = None, year: str = "year") -> DataFrame:
    """Rows of a year range; prunes directories when the table is stored by year."""
    if first is not None:
        df = df.filter(F.col(year) >= first)
    if last is not None:
        df = df.filter(F.col(year) <= last)
    return df


def first_versions(df: DataFrame, version: str, types: Column) -> DataFrame:
    """First document of each filing, of the wanted types."""
    return df.filter((F.col(version) == 1) & types)
