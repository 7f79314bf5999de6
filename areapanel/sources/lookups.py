"""Lookup tables that keep the results of expensive enrichments between runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.operators.joins import missing_keys
from areapanel.operators.scale import lookup_join, materialize_counted
from areapanel.sources import store


def _one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by its other columns in order, so that the choice does not depend on partitions."""
    rest = [c for c in df.columns if c not in set(keys)]
    if not rest:
        return df.distinct()
    least = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_least"))
    return least.select(*[F.col("_least").getField(c).alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])


def load_lookup(spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str] = ()) -> DataFrame:
    """The stored lookup, or an empty one if none has been stored yet; with ``keys``, one row for each."""
    parts = store.folders(spark, path)
    if not parts:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(schema).parquet(*parts)
    return _one_per_key(stored, keys) if keys else stored


def merge_lookup(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old entries plus those new ones whose key is not known yet, one row per key."""
    added = _one_per_key(new, keys).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(added)


def extend_lookup(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Store the entries the lookup lacks as a part of their own; stored files are never rewritten (see ``store``).

    Runs at the same time may both store a key: readers keep one row for each.
    """
    added, rows = materialize_counted(_one_per_key(new, keys).join(load_lookup(spark, path, new.schema).select(*keys), list(keys), "left_anti"))
    if rows:
        store.append(added, path)
    return load_lookup(spark, path, new.schema, keys)


def resolve_through_lookup(
    df: DataFrame, path: str, keys: Sequence[str], schema: T.StructType | str, resolve: Callable[[DataFrame], DataFrame],
    how: str = "left",
) -> DataFrame:
    """Resolve only keys not stored yet, store them, and bring all results to the rows."""
    spark = df.sparkSession
    known = load_lookup(spark, path, schema, keys)
    fresh = resolve(missing_keys(df, known, keys)).select(*known.columns)
    stored = extend_lookup(spark, path, fresh, keys)
    return lookup_join(df, stored, keys, how, derived=False)
