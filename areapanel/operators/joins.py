"""Joins of the panel: enrichment, shifted years, unresolved keys, grids and neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.functions.clean import split_ints
from areapanel.operators.missing import without_nan
from areapanel.operators.scale import lookup_join, materialize

PANEL_KEYS = ("area", "year")


class DuplicateKeys(ValueError):
    """The right side of an enrichment has a key more than once."""


def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1)
    if twice.count():
        raise DuplicateKeys(f"keys {list(keys)} are not unique")


def enrich(
    panel: DataFrame, other: DataFrame, on: Mapping[str, str] | Sequence[str] = PANEL_KEYS,
    cols: Sequence[str] | None = None, expect_unique: bool = False,
) -> DataFrame:
    """Left join of ``other``'s columns; ``on`` maps panel keys to differently named keys of ``other``.

    With ``expect_unique`` the row count of the panel is guaranteed: a repeated key of ``other`` raises.
    """
    names = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
    wanted = list(cols) if cols is not None else [c for c in other.columns if c not in names.values()]
    right = other.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in names.items()], *wanted)
    if expect_unique:
        check_unique(right, list(names))
    return panel.join(right, list(names), "left")


def shift_year(df: DataFrame, by: int, year: str = "year") -> DataFrame:
    return df.withColumn(year, (F.col(year) + by).cast("int"))


def lagged_join(
    df: DataFrame, other: DataFrame, shift: int = 1, keys: Sequence[str] = PANEL_KEYS, how: str = "inner"
) -> DataFrame:
    """Meet ``other``'s values of ``shift`` years ago with this year's rows."""
    return df.join(shift_year(other, shift), list(keys), how)


def with_value_at(panel: DataFrame, value: str, ahead: int, name: str, how: str = "inner") -> DataFrame:
    """``value`` of the same area ``ahead`` years later as a new column: targets and next-year inputs."""
    later = shift_year(panel.select("area", "year", F.col(value).alias(name)), -ahead)
    return panel.join(later, list(PANEL_KEYS), how)


def missing_keys(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``lookup`` does not hold yet; keys with a NULL cannot be looked up."""
    wanted = df.select(*keys).dropna("any").distinct()
    return wanted.join(lookup.select(*keys), list(keys), "left_anti")


def enrich_distinct(df: DataFrame, keys: Sequence[str], resolve, how: str = "inner") -> DataFrame:
    """Resolve each distinct key once with ``resolve(DataFrame of keys)`` and bring the result back to the rows."""
    resolved = resolve(df.select(*keys).dropna("any").distinct())
    return lookup_join(df, resolved, keys, how)


def patch(df: DataFrame, key: str, overrides: Mapping, col: str) -> DataFrame:
    """Replace ``col`` for the rows whose key is listed in ``overrides`` (a short literal table)."""
    if not overrides:
        return df
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(k, v) for k, v in overrides.items()], [key, "_new"]
    ).withColumns({key: F.col(key).cast(df.schema[key].dataType), "_new": F.col("_new").cast(df.schema[col].dataType)})
    joined = df.join(F.broadcast(table), key, "left")
    return joined.withColumn(col, F.coalesce("_new", col)).select(*df.columns)


def cross_years(df: DataFrame, years: Sequence[int], year: str = "year") -> DataFrame:
    """One copy of each row per year."""
    return df.withColumn(year, F.explode(F.array(*[F.lit(int(y)) for y in years])))


def complete_grid(
    counts: DataFrame, areas: DataFrame, dims: Mapping[str, Sequence | DataFrame], value: str = "count", area: str = "area"
) -> DataFrame:
    """Every (area, dims...) combination, with 0 where ``counts`` has no row.

    Zero rows are made by exploding the lists ``dims`` per distinct area, unioned below the counts, and summed by key: one
    shuffle, with the rows combined before it, and no join. A dimension may be a frame: its distinct values of that
    column are then the list, as a scalar that never reaches the driver.
    """
    kind = counts.schema[value].dataType
    zeros = areas.select(area).dropna().distinct()
    for name, values in dims.items():
        if isinstance(values, DataFrame):
            typed = values.agg(F.collect_set(name)).scalar()
        else:
            typed = F.array(*[F.lit(v) for v in values])
        typed = typed.cast(f"array<{counts.schema[name].dataType.simpleString()}>")
        zeros = zeros.withColumn(name, F.explode(typed))
    keys = [area, *dims]
    inside = [F.col(name).isNotNull() if isinstance(values, DataFrame) else F.col(name).isin(list(values))
              for name, values in dims.items()]
    kept = counts.join(areas.select(area).distinct(), area, "left_semi")
    for test in inside:
        kept = kept.filter(test)
    both = kept.select(*keys, value).unionByName(zeros.withColumn(value, F.lit(0).cast(kind)))
    return both.groupBy(*keys).agg(F.sum(value).cast(kind).alias(value))


def edges(adjacency: DataFrame, area: str = "area", listed: str = "adjacent") -> DataFrame:
    """(area, nbr) pairs from a comma-separated list."""
    return adjacency.select(area, F.explode(split_ints(F.col(listed))).alias("nbr"))


def neighbor_avg(
    panel: DataFrame, adjacency: DataFrame, values: Mapping[str, str], strict: bool = False, digits: int = 2
) -> DataFrame:
    """Means over the listed neighbours present in the same year, NULL if none is; ``values`` maps column -> name.

    A neighbour without a value is left out; with ``strict`` it makes the mean NULL. The panel is written out once,
    since it is checked, looked up in, and extended.
    """
    panel = materialize(without_nan(panel, values))
    check_unique(panel, PANEL_KEYS)
    pairs = panel.select("area", "year").join(edges(adjacency), "area")
    theirs = {v: f"_v{i}" for i, v in enumerate(values)}
    looked_up = panel.select(F.col("area").alias("nbr"), "year", *[F.col(v).alias(c) for v, c in theirs.items()])
    met = lookup_join(pairs, looked_up, ["nbr", "year"], "inner", derived=False)

    def mean(c):
        m = F.avg(c)
        return F.when(F.count(c) == F.count(F.lit(1)), m) if strict else m

    means = met.groupBy("area", "year").agg(*[F.bround(mean(theirs[v]), digits).alias(n) for v, n in values.items()])
    return panel.join(means, list(PANEL_KEYS), "left")


def join_features(features: DataFrame, df: DataFrame, key: str, col: str, default: str) -> DataFrame:
    """All features, with ``col`` of ``df`` or ``default`` for a feature that ``df`` does not cover."""
    return lookup_join(features, df.select(key, col), [key], "left").withColumn(
        col, F.coalesce(F.col(col), F.lit(default))
    )


def describe_key(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Bring a description table's columns to the rows with that key."""
    return lookup_join(df, table, [key], "left")


def parse_once(df: DataFrame, col: str, parse, name: str) -> DataFrame:
    """Apply an expensive column function to each distinct value once and join the result back."""
    table = df.select(col).dropna().distinct().withColumn(name, parse(F.col(col)))
    return lookup_join(df, table, [col], "left")


def dropped_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of left and right keys an inner join would leave out."""
    l, r = materialize(left.select(*keys).distinct()), materialize(right.select(*keys).distinct())
    only_left = l.join(r, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("left"))
    only_right = r.join(l, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right).select("side", "n")


def when_any(tests: Sequence[Column]) -> Column:
    """OR chain."""
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
