"""Cleaning of raw text columns. A value that does not parse becomes NULL, never an error."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The address pattern that holds a postal code between the state and the country.
ZIP_IN_ADDRESS = r"NY (.*?), U"


def parse_money(c: Column) -> Column:
    """'$1,234' -> 1234.0"""
    return F.regexp_replace(c, r"[$,]", "").try_cast("double")


def parse_percent(c: Column) -> Column:
    """'12.3%' -> 12.3"""
    return F.replace(c, F.lit("%"), F.lit("")).try_cast("double")


def yes_no(c: Column) -> Column:
    """'Y' -> 1, everything else and NULL -> 0"""
    return F.when(c == "Y", 1).otherwise(0)


def trimmed(c: Column) -> Column:
    return F.trim(c)


def digits(c: Column) -> Column:
    """Only the digits of a text."""
    return F.regexp_replace(c, "[^0-9]", "")


def join_words(*cols: Column) -> Column:
    """Trim the parts and join them with one space; NULL parts are left out."""
    return F.concat_ws(" ", *[F.trim(c) for c in cols])


def prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c)


def url_key(c: Column) -> Column:
    """Text as a query word: spaces become '+'."""
    return F.replace(c, F.lit(" "), F.lit("+"))


def extract_zip(c: Column) -> Column:
    """Postal code inside a formatted address, first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(c, ZIP_IN_ADDRESS, 1), F.lit(""))


def first_match(items: Column, extract) -> Column:
    """First non-NULL ``extract(item)`` over the items of an array."""
    return F.try_element_at(F.filter(F.transform(items, extract), lambda x: x.isNotNull()), F.lit(1))


def year_prefix(c: Column) -> Column:
    """Year from the first four characters; works for dates a parser would refuse."""
    return F.substring(c, 1, 4).try_cast("int")


def to_day(c: Column, fmt: str) -> Column:
    return F.try_to_date(c, fmt)


def to_year(c: Column, fmt: str) -> Column:
    return F.year(F.try_to_date(c, fmt))


def split_ints(c: Column) -> Column:
    """'10018, 10016' -> [10018, 10016]; items that are no number are left out."""
    numbers = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int"))
    return F.filter(numbers, lambda x: x.isNotNull())


def split_words(c: Column, sep: str) -> Column:
    """Items of a separated list, trimmed, empty ones left out."""
    words = F.transform(F.split(c, f"\\Q{sep}\\E"), lambda x: F.trim(x))
    return F.filter(words, lambda x: x != "")


def bin_labels(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge the value does not exceed; the last label has no edge. NULL stays NULL."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(c <= edge, label) if out is None else out.when(c <= edge, label)
    return F.when(c.isNotNull(), out.otherwise(labels[-1]) if out is not None else F.lit(labels[-1]))


def map_labels(c: Column, mapping: Mapping[str, str], default: str) -> Column:
    """Label of a category; ``default`` for an unknown or missing one."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(c, F.lit(""))), F.lit(default))


def cast_cols(df: DataFrame, cols: Iterable[str], to: str) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").try_cast(to) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def drop_cols(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(names))


def cols_except(df: DataFrame, leave_out: Iterable[str]) -> list[str]:
    out = set(leave_out)
    return [c for c in df.columns if c not in out]


def snake_names(df: DataFrame) -> DataFrame:
    """'Zip Code' -> zip_code, for every column; also drops a byte-order mark before the first name."""
    def tidy(name: str) -> str:
        kept = "".join(ch if ch.isalnum() else " " for ch in name.replace("﻿", ""))
        return "_".join(kept.lower().split())

    return df.toDF(*[tidy(c) for c in df.columns])
