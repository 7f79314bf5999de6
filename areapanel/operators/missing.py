"""One rule for missing values: NULL and NaN are the same. Operators apply it to the columns they compute with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(df: DataFrame, col: str) -> Column:
    """The column with NaN as NULL, so that aggregates and windows leave it out and sorts put it last."""
    c = F.col(f"`{col}`")
    return F.nanvl(c, F.lit(None).cast(df.schema[col].dataType)) if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)) else c


def without_nan(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """``df`` with NULL for NaN in ``cols``, or in all columns of numbers that can hold it."""
    wanted = df.columns if cols is None else list(dict.fromkeys(cols))
    changed = {c: known(df, c) for c in wanted if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(changed) if changed else df
