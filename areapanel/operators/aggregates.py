"""Grouped aggregates. All combine rows before the shuffle, so a hot group costs one row per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.operators.missing import known, without_nan


def count_by(df: DataFrame, keys: Sequence[str], name: str = "count", drop_null_keys: bool = True) -> DataFrame:
    """Rows per key; rows with a missing key are not counted unless asked for."""
    if drop_null_keys:
        df = df.dropna("any", subset=list(keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sums of what is known; NULL where a group knows nothing of a column."""
    return df.groupBy(*keys).agg(*[F.sum(known(df, c)).alias(c) for c in cols])


def avg_by(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Mean of the known values."""
    return df.groupBy(*keys).agg(F.avg(known(df, col)).alias(name))


def count_distinct(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of levels of each column, one row."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(known(df, c)).alias(c) for c in cols])


def min_by_key(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """First year (or smallest value) per key."""
    return df.dropna("any", subset=list(keys)).groupBy(*keys).agg(F.min(known(df, col)).alias(name))


def earliest(df: DataFrame, entity: str, day: str) -> DataFrame:
    """The rows of each entity on its first day, all of them if there are several.

    A rank that is compared with a constant lets Spark leave out later days before the shuffle.
    """
    w = Window.partitionBy(entity).orderBy(day)
    known = df.filter(F.col(entity).isNotNull() & F.col(day).isNotNull())
    return known.withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key by an explicit order.

    A row number that is compared with a constant lets Spark keep one row per key and task before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def bbox(df: DataFrame, area: str, x: str, y: str, years: Sequence[int] | None = None, year: str = "year") -> DataFrame:
    """Largest and smallest coordinates per area, over all years or some, in one aggregate."""
    if years is not None:
        df = df.filter(F.col(year).isin(list(years)))
    df = without_nan(df, [x, y])
    return df.dropna("any", subset=[area]).groupBy(area).agg(
        F.max(y).alias("max_y"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.min(x).alias("min_x")
    )


def sums_by_category(
    df: DataFrame, keys: Sequence[str], category: str, value: str, values: Sequence[str]
) -> DataFrame:
    """One sum column per category value, 0 where none."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(category) == v, known(df, value)).otherwise(0)).alias(v) for v in values]
    )


def yearly_mean(df: DataFrame, area: str, month: str, value: str, name: str) -> DataFrame:
    """Mean over the months of a year that have a value; ``month`` is 'YYYY-MM'."""
    year = F.substring(F.col(month), 1, 4).try_cast("int")
    return df.groupBy(F.col(area), year.alias("year")).agg(F.avg(known(df, value)).alias(name))


def rate_by(df: DataFrame, area: str, cols: Sequence[str], periods: int) -> DataFrame:
    """Mean, sample deviation and rate (sum / periods) of each column per area."""
    out, df = [], without_nan(df, cols)
    for c in cols:
        out += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"),
                (F.sum(c) / F.lit(float(periods))).alias(f"rate_{c}")]
    return df.groupBy(area).agg(*out)


def metrics(df: DataFrame, actual: str, predicted: str, span: tuple[Column, Column] | None = None) -> DataFrame:
    """MSE, MAPE in percent, R2 and range-scaled bias, one row.

    ``span`` is (max, min) of the target when it covers more rows than ``df``, such as train and test together.
    Total variation comes from moments, so one pass is enough. NaN counts as missing; what would be divided by zero is NULL.
    """
    y, p = F.col(actual), F.col(predicted)
    hi, lo = span or (F.max(y), F.min(y))
    n = F.count(F.lit(1))
    sse = F.sum((y - p) * (y - p))
    return df.dropna("any", subset=[actual, predicted]).agg(
        n.alias("n"),
        F.try_divide(sse, n).alias("mse"),
        (F.avg(F.abs(F.try_divide(y - p, y))) * 100).alias("mape"),
        (F.lit(1.0) - F.try_divide(sse, F.var_pop(y) * n)).alias("r2"),
        (F.lit(1.0) - F.try_divide(F.abs(F.avg(p - y)), hi - lo)).alias("performance"),
    )


def reg_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x, over the rows that have both."""
    df = without_nan(df, [x, y])
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )


def compound(df: DataFrame, rate: str, keys: Sequence[str] = (), name: str = "factor") -> DataFrame:
    """Product of (1 + rate) over the known rates."""
    return df.groupBy(*keys).agg(F.product(known(df, rate) + 1).alias(name))


def distinct_tokens(df: DataFrame, col: str, sep: str, name: str = "token") -> DataFrame:
    """Distinct trimmed items of a separated text column, empty ones left out."""
    from areapanel.functions.clean import split_words

    return df.select(F.explode(split_words(F.col(col), sep)).alias(name)).distinct()


def max_min(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Largest and smallest value of each column; names come from the mapping column -> alias."""
    out, df = [], without_nan(df, cols)
    for c, alias in cols.items():
        out += [F.max(c).alias(f"max_{alias}"), F.min(c).alias(f"min_{alias}")]
    return df.agg(*out)
