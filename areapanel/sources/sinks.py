"""Writers. All write from the executors; none brings rows to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from areapanel.sources import store


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet by default; CSV gets a header line and no index column."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_by_year(
    df: DataFrame, path: str, year: str = "year", fmt: str = "parquet", mode: str = "errorifexists",
    rows_per_file: int = 5_000_000,
) -> None:
    """One directory per year. Rows are rebalanced by year first, so that a year is not scattered over one small
    file per task; a large year is split by the engine and by the row limit of a file."""
    writer = df.hint("rebalance", year).write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(year)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def is_stored(spark: SparkSession, path: str) -> bool:
    """True if a table has been built there: a manifest names its folder."""
    return bool(store.manifests(spark, path))


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the stored table, or build and store it first.

    A half-written table does not count and is never overwritten. Of builds at the same time one table stays, which all
    of them return; ``store.sweep`` deletes what the others wrote.
    """
    if not is_stored(spark, path):
        part = store.write_part(build(), path)
        if not is_stored(spark, path):  # else another build was quicker
            store.commit(spark, path, part, 1)
            store.first_of(spark, path, part)
    return spark.read.parquet(store.folders(spark, path)[0])


def write_predictions(
    df: DataFrame, path: str, actual: str, predicted: str, fmt: str = "csv", mode: str = "errorifexists"
) -> None:
    """(year, area, actual, predicted), one row per prediction."""
    rows = df.select("year", "area", df[actual].alias("actual"), df[predicted].alias("predicted"))
    write_table(rows, path, fmt, mode)
