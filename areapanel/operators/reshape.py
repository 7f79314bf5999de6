"""Long and wide forms, unions, sections and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.operators.missing import known, without_nan
from areapanel.operators.scale import fill_forward, group_lookup, lookup_join, materialize, number_rows

# Hexadecimal digits of a hash by which hashes are counted: at most 16^5 counters.
PREFIX = 5


def pivot_counts(
    df: DataFrame, keys: Sequence[str], category: str, values: Sequence, value: str, fill: int | None = 0
) -> DataFrame:
    """One column per category value; missing combinations become ``fill`` or NULL.

    Rows with a missing key are left out. Conditional sums need one shuffle, where ``pivot`` aggregates twice.
    """
    df = df.dropna("any", subset=list(keys))
    wide = df.groupBy(*keys).agg(*[F.sum(F.when(F.col(category) == v, known(df, value))).alias(str(v)) for v in values])
    return wide if fill is None else wide.fillna(fill, subset=[str(v) for v in values])


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], category: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), category, value)


def unpivot_periods(df: DataFrame, ids: Sequence[str], period: str = "month", value: str = "value") -> DataFrame:
    """All columns but the id columns are periods; the result is long."""
    periods = [c for c in df.columns if c not in set(ids)]
    return df.unpivot(list(ids), periods, period, value)


def concat(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def distinct_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def explode_list(df: DataFrame, col: str, name: str, sep: str = ",") -> DataFrame:
    """One row per item of a separated list."""
    from areapanel.functions.clean import split_words

    return df.withColumn(name, F.explode(split_words(F.col(col), sep)))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of a report; end ``order`` with a unique key."""
    return df.orderBy(*order).limit(k)


def normalize_by_group_max(
    df: DataFrame, group: str, period: str, base: str, value: str, name: str = "value_norm"
) -> DataFrame:
    """Divide by the group's largest known value in the base period; groups without one are left out.

    Rows without a group are a group; a row without a value stays, without a result.
    """
    df = without_nan(df, [value])
    top = df.filter(F.col(period) == base).groupBy(group).agg(F.max(value).alias("_top")).filter("_top IS NOT NULL")
    joined = group_lookup(df, top, [group])
    return joined.withColumn(name, F.try_divide(F.col(value), F.col("_top"))).drop("_top")


def normalize_by_base(
    df: DataFrame, series: Sequence[str], period: str, base: str, value: str, name: str = "value_norm"
) -> DataFrame:
    """Divide by the same series' own value in the base period; NULL where it has none."""
    df = without_nan(df, [value])
    own = df.filter(F.col(period) == base).groupBy(*series).agg(F.max(value).alias("_base"))
    joined = group_lookup(df, own, list(series), "left")
    return joined.withColumn(name, F.try_divide(F.col(value), F.col("_base"))).drop("_base")


def factor_code(df: DataFrame, col: str, name: str = "code", **kw) -> DataFrame:
    """Whole-number code 1.. of a text column in the order of its levels; NULL stays NULL."""
    return lookup_join(df, factor_levels(df, col, name, **kw), [col], "left")


def factor_levels(df: DataFrame, col: str, name: str = "code", **kw) -> DataFrame:
    """The dictionary behind ``factor_code``, to be shared between frames."""
    levels = df.select(col).dropna().distinct()
    return number_rows(levels, [], [F.col(col).asc()], name, **kw).withColumn(name, F.col(name).cast("int"))


def fill_sections(
    df: DataFrame, header: str, order: Sequence[str], block: Column | None = None, file: Sequence[str] = (),
    name: str = "section", one_task_rows: int | None = None,
) -> DataFrame:
    """Give each row the last non-NULL ``header`` at or before it in its file, in ``order``.

    ``block``, if given, comes before ``order``, for lines that are numbered inside blocks. A file of any size is spread over
    all tasks: see ``fill_forward``.
    """
    first = [] if block is None else [block]
    return fill_forward(df, list(file), [*first, *[F.col(c) for c in order]], header, name, one_task_rows)


def split_by_share(
    df: DataFrame, key: str, share: float, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly floor(share * n) rows in seeded random order go to train.

    Rows are ordered by a hash of seed and unique key, and split by comparison with the hash at the cut. To find it,
    hashes are counted by their first ``PREFIX`` digits (a table of fixed size), and only those that share the cut's
    prefix, about one in a million, are put in order. Nothing else is sorted or shuffled. A missing key is a key like others;
    rows with equal keys stay together, so keys that repeat may take the shares a little off.
    """
    mark = F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), F.lit(f"{seed}")))
    hashes = df.select(mark.alias("_h")).withColumn("_p", F.substring("_h", 1, PREFIX))
    counts = materialize(hashes.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    k = int(n * share)
    if k == 0:
        return df.filter(F.lit(False)), df
    upto = Window.partitionBy(F.lit(0)).orderBy("_p")
    at = (
        counts.withColumn("_upto", F.sum("_n").over(upto)).filter(F.col("_upto") >= k).orderBy("_p")
        .select("_p", (F.lit(k) - F.col("_upto") + F.col("_n")).alias("_place")).first()
    )
    cut = hashes.filter(F.col("_p") == at["_p"]).orderBy("_h").limit(at["_place"]).agg(F.max("_h")).scalar()
    return df.filter(mark <= cut), df.filter(mark > cut)
