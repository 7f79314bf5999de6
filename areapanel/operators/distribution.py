"""Quantiles, summaries, box plots, histograms and densities, exact for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.operators.missing import known
from areapanel.operators.scale import (
    BROADCAST_BYTES, BROADCAST_ROWS, ONE_TASK_ROWS, group_lookup, lookup_join, materialize, materialize_observed, running_sum,
)

# The sketch finds a rank to within 1 / ACCURACY of a group's rows; a bracket reaches MARGIN times as far to either side.
ACCURACY = 10_000
MARGIN = 3
# Stands for an infinite value while quantiles are sought.
LARGEST = 1.7976931348623157e308


def quantile_by(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], approximate: bool = False,
    one_task_rows: int | None = None, derived: bool = False, accuracy: int = ACCURACY, margin: float = MARGIN,
) -> DataFrame:
    """Quantiles with linear interpolation per group, one column per entry of ``probs``.

    One pass counts the rows and makes a mergeable sketch. Few rows then go through ``percentile``; of many only those
    near the wanted ranks are counted by value, see ``_bracketed``. ``derived`` writes keys and values out first, so that
    what ``df`` is made from is computed once. Missing values (NULL and NaN) are left out; a group without any value has
    no row, and the rows without a key are a group. Infinite values are the smallest and largest there are.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    v = F.col(value).cast("double")
    df = df.select(key.alias("_key"), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    groups = [F.col(f"_key.`{c}`").alias(c) for c in by]
    if approximate:
        found = df.groupBy("_key").agg(*[F.percentile_approx("_v", p).alias(n) for n, p in probs.items()])
        return found.select(*groups, *probs)
    df = materialize(df) if derived else df
    limit = ONE_TASK_ROWS if one_task_rows is None else one_task_rows
    # Infinite values take part as the largest finite number.
    up, down = F.col("_v") == float("inf"), F.col("_v") == float("-inf")
    df = df.select("_key", F.when(up, LARGEST).when(down, -LARGEST).otherwise(F.col("_v")).alias("_v"), up.cast("int").alias("_u"), down.cast("int").alias("_d"))
    counts = [F.count(F.lit(1)).alias("_n"), F.sum("_u").alias("_up"), F.sum("_d").alias("_down")]
    places = [min(1.0, max(0.0, float(p) + side * margin / accuracy)) for p in probs.values() for side in (-1, 1)]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in places]), accuracy).alias("_marks")
    stats, seen = materialize_observed(df.groupBy("_key").agg(*counts, F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), sketch),
                                       groups=F.count(F.lit(1)), rows=F.sum("_n"), largest=F.max("_n"))
    if (seen["rows"] or 0) <= limit:
        found = df.groupBy("_key").agg(*counts, F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q"))
        found = found.select("_key", "_n", "_up", "_down", *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    else:
        found = _bracketed(df.select("_key", "_v"), stats, probs, seen, accuracy, margin)
    return found.select(*groups, *[_infinite(F.col(n), p).alias(n) for n, p in probs.items()])


def _place(p: float) -> Column:
    return (F.col("_n") - 1) * F.lit(float(p))


def _bracketed(df: DataFrame, stats: DataFrame, probs: dict[str, float], seen: dict, accuracy: int, margin: float) -> DataFrame:
    """Exact quantiles from one more pass over the rows, which sorts none of them.

    The sketch gives each wanted rank a bracket of values. Rows inside a bracket are counted by value, all others by the gap
    between brackets they are in, so that running sums of the counts give every value's rank; a group that the sketch
    holds whole is one bracket. A hot group costs each task a row per value near a wanted rank. A rank outside its
    bracket, which the sketch rules out, is an error and no wrong result.
    """
    few = F.col("_n") <= accuracy
    pairs = [F.struct(F.get("_marks", F.lit(2 * i)).alias("a"), F.get("_marks", F.lit(2 * i + 1)).alias("b")) for i in range(len(probs))]
    brackets = F.when(few, F.array(F.struct(F.col("_lo").alias("a"), F.col("_hi").alias("b")))).otherwise(F.array(*pairs))
    ranks = F.array_distinct(F.array(*[f(_place(p)).cast("bigint") for p in probs.values() for f in (F.floor, F.ceil)]))
    packed = stats.select("_key", "_n", "_up", "_down", brackets.alias("_brackets"))
    small = seen["groups"] <= BROADCAST_ROWS and seen["groups"] * 64 * (2 + len(probs)) <= BROADCAST_BYTES
    rows = df.join(F.broadcast(packed), "_key") if small else lookup_join(df, packed, ["_key"], "inner", derived=False)
    inside = F.exists("_brackets", lambda s: (s["a"] <= F.col("_v")) & (F.col("_v") <= s["b"]))
    gap = F.size(F.filter("_brackets", lambda s: s["b"] < F.col("_v")))
    counted = rows.groupBy("_key", F.when(inside, F.col("_v")).alias("_own"), F.when(~inside, gap).alias("_gap")).agg(
        F.count(F.lit(1)).alias("_count"), F.max("_v").alias("_at"), *[F.first(c).alias(c) for c in ("_n", "_up", "_down")])  # numbers only, so that it is a hash aggregate
    # Values in brackets of one group: what the sketch may be off, or a group that it holds whole.
    if max(accuracy, seen["largest"] * 2 * (margin + 1) * len(probs) / accuracy) <= ONE_TASK_ROWS:
        upto = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counted.withColumn("_upto", F.sum("_count").over(upto))
    else:
        ranked = running_sum(counted, ["_key"], [F.col("_at").asc()], "_count", "_upto")
    hits = F.filter(ranks, lambda r: (r >= F.col("_upto") - F.col("_count")) & (r < F.col("_upto")))
    checked = F.when(F.col("_gap").isNull(), F.col("_at")).otherwise(
        F.raise_error(F.lit("a rank lies outside the bracket of its sketch; give a larger margin")).cast("double"))
    hit = ranked.filter(F.size(hits) > 0).select("_key", "_n", "_up", "_down", F.explode(hits).alias("_rank"), checked.alias("_v"))
    out = []
    for name, p in probs.items():
        low = F.max(F.when(F.col("_rank") == F.floor(_place(p)), F.col("_v")))
        high = F.max(F.when(F.col("_rank") == F.ceil(_place(p)), F.col("_v")))
        share = F.max(_place(p) - F.floor(_place(p)))
        out.append((low + (high - low) * share).alias(name))
    return hit.groupBy("_key", "_n", "_up", "_down").agg(*out)


def _infinite(q: Column, p: float) -> Column:
    """Infinite where the row at the wanted place, or one of the two beside it, is."""
    place = _place(p)
    return F.when(F.ceil(place) >= F.col("_n") - F.col("_up"), float("inf")).when(F.floor(place) < F.col("_down"), float("-inf")).otherwise(q)


def below_group_quantile(
    df: DataFrame, by: Sequence[str], value: str, p: float, at_or_above: bool = False, **kw
) -> DataFrame:
    """Rows strictly below their group's quantile, or at or above it. No ``by``: the quantile of all rows.

    A row without a value is neither; rows without a key are a group.
    """
    q = quantile_by(df, by, value, {"_q": p}, **kw)
    if by:
        joined = group_lookup(df, q, list(by))
    else:
        joined = df.withColumn("_q", q.scalar())
    v = known(df, value)
    return joined.filter(v >= F.col("_q") if at_or_above else v < F.col("_q")).drop("_q")


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two tables with one row per group; group keys may be NULL."""
    if not by:
        return left.withColumns({c: right.select(c).scalar() for c in right.columns})
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in by else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in by])
    return left.join(renamed, match, "left").drop(*[f"_r_{c}" for c in by])


def present(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither NULL nor NaN."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def describe_by(df: DataFrame, by: Sequence[str], value: str, **kw) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max; NULL and NaN are missing values."""
    df, v = present(df, value), F.col(value)
    moments = df.groupBy(*by).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    quartiles = quantile_by(df, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, **kw)
    return _attach(moments, materialize(quartiles), by).select(
        *by, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def _fences(df: DataFrame, by: Sequence[str], value: str, **kw) -> DataFrame:
    q = quantile_by(df, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, **kw)
    reach = (F.col("q75") - F.col("q25")) * 1.5
    return materialize(q.withColumns({"low_fence": F.col("q25") - reach, "high_fence": F.col("q75") + reach}))


def box_stats(df: DataFrame, by: Sequence[str], value: str, **kw) -> DataFrame:
    """Quartiles, whiskers (outermost values within 1.5 quartile distances) and number of outliers per group.

    Rows without a value take no part; rows without a key are a group.
    """
    v = F.col(value)
    fences = _fences(df, by, value, **kw)
    rows = group_lookup(present(df, value).select(*by, value), fences, list(by), derived=False)
    inside = v.between(F.col("low_fence"), F.col("high_fence"))
    return rows.groupBy(*by).agg(
        F.first("q25").alias("q25"), F.first("q50").alias("q50"), F.first("q75").alias("q75"),
        F.min(F.when(inside, v)).alias("low_whisker"), F.max(F.when(inside, v)).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"),
    )


def box_outliers(df: DataFrame, by: Sequence[str], value: str, **kw) -> DataFrame:
    """The rows outside their group's fences."""
    v = F.col(value)
    fences = _fences(df, by, value, **kw)
    rows = group_lookup(present(df, value), fences, list(by), derived=False)
    return rows.filter((v < F.col("low_fence")) | (v > F.col("high_fence"))).select(*df.columns)


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin (0-based) over the range of all finite values, per group; empty bins have no row.

    The range is one row, read as a scalar; the largest value belongs to the last bin. Missing values are in no bin,
    infinite ones in the first and last.
    """
    v = F.col(value).cast("double")
    df = present(df, value).select(*by, v.alias("_v"))
    finite = F.when(F.abs("_v") != float("inf"), F.col("_v"))
    span = materialize(df.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    df = df.withColumn("_v", F.greatest(F.least("_v", span.select("hi").scalar()), span.select("lo").scalar()))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    place = F.floor(F.try_divide((F.col("_v") - lo) * bins, hi - lo))
    bin_ = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumns({
        "left": lo + (hi - lo) * F.col("bin") / bins, "right": lo + (hi - lo) * (F.col("bin") + 1) / bins,
    }).select(*by, "bin", "left", "right", "count")


def kde(df: DataFrame, by: Sequence[str], value: str, points: int = 512, cut: float = 3.0, **kw) -> DataFrame:
    """Gaussian kernel density on ``points`` grid points per group, from binned data.

    Bandwidth 0.9 * min(sd, IQR / 1.34) * n^-0.2; the grid reaches ``cut`` bandwidths past the values. Each value's
    weight is split linearly between its two grid points, so what is left per group is at most ``points`` weights
    and the kernel runs over those, not over the rows. Needs two different values in a group. Infinite values lie on no
    grid and take no part; rows without a key are a group.
    """
    df = df.filter(F.abs(F.col(value).cast("double")) < float("inf"))  # NULL and NaN go too
    stats = describe_by(df, by, value, **kw)
    spread = F.least(F.col("std"), F.when(F.col("q75") > F.col("q25"), (F.col("q75") - F.col("q25")) / 1.34)
                     .otherwise(F.col("std")))
    stats = stats.filter("std > 0").withColumn("_bw", spread * 0.9 * F.pow(F.col("count").cast("double"), -0.2))
    stats = materialize(stats.select(
        *by, F.col("_bw").alias("bw"), F.col("count").alias("_n"), (F.col("min") - F.col("_bw") * cut).alias("_lo"),
        ((F.col("max") - F.col("min") + F.col("_bw") * (2 * cut)) / (points - 1)).alias("_step"),
    ))
    rows = present(df, value).select(*by, F.col(value).cast("double").alias("_v"))
    rows = group_lookup(rows, stats, list(by), derived=False) if by else rows.withColumns(
        {c: stats.select(c).scalar() for c in stats.columns})
    at = (F.col("_v") - F.col("_lo")) / F.col("_step")
    cell = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    rows = rows.withColumns({"_cell": cell, "_share": at - cell})
    # Each value gives 1 - share to its left grid point and share to the right one.
    sums = rows.groupBy(*by, "_cell").agg(
        F.sum(F.lit(1.0) - F.col("_share")).alias("_left"), F.sum("_share").alias("_right"),
        F.first("bw").alias("bw"), F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_step").alias("_step"),
    )
    weights = sums.withColumn("_w", F.explode(F.array(
        F.struct(F.col("_cell").alias("cell"), F.col("_left").alias("w")),
        F.struct((F.col("_cell") + 1).alias("cell"), F.col("_right").alias("w")),
    ))).select(*by, "bw", "_n", "_lo", "_step", "_w.cell", "_w.w")
    # At most points weights per group.
    packed = weights.groupBy(*by, "bw", "_n", "_lo", "_step").agg(F.sort_array(F.collect_list(F.struct("cell", "w"))).alias("_ws"))
    grid = packed.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    step_in_bw = F.col("_step") / F.col("bw")

    def kernel(acc, e):
        z = (F.col("point") - e["cell"]) * step_in_bw
        return acc + e["w"] * F.exp(z * z * -0.5)

    total = F.aggregate("_ws", F.lit(0.0), kernel)
    return grid.select(
        *by, "point", (F.col("_lo") + F.col("_step") * F.col("point")).alias("x"),
        (total / (F.col("_n") * F.col("bw") * 2.5066282746310002)).alias("density"),
    )


def quantile_cut(df: DataFrame, value: str, cuts: str | Sequence[str], name: str = "interval") -> DataFrame:
    """Number of cut columns the value has reached: 0 below all of them."""
    cols = [cuts] if isinstance(cuts, str) else list(cuts)
    reached = [F.when(F.col(value) >= F.col(c), 1).otherwise(0) for c in cols]
    return df.withColumn(name, reduce(lambda a, b: a + b, reached))
