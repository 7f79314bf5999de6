"""Feature tables, fits with Spark ML, and scoring from parameter tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import (
    GeneralizedLinearRegression, LinearRegression, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.functions.clean import fill_zero, parse_percent, yes_no
from areapanel.functions.probability import gamma_params, weighted_sum
from areapanel.operators.forest import LEAST_ROWS, grow_forest, places
from areapanel.operators.missing import without_nan
from areapanel.operators.scale import BROADCAST_BYTES, lookup_join, materialize, materialize_counted, scratch_path

FEATURES = "features"
# Coefficients of up to this many groups are broadcast in every round of a per-group fit.
SMALL_GROUPS = 10_000
# Nodes of a forest that may be broadcast, if they also fit the bound in bytes.
FOREST_NODES = 1_000_000
# Bytes of a block of posterior draws, on average, and bins by which the scores of a row under all draws are counted.
DRAW_ROW_BYTES = 400
DRAW_BINS = 64
# Rounds of a per-group fit in one plan, before its coefficients are written out.
ROUNDS_AT_ONCE = 4


def feature_table(
    panel: DataFrame, drop: Sequence[str], percents: Sequence[str] = (), flags: Sequence[str] = (),
    zero_fill: Sequence[str] = (),
) -> DataFrame:
    """Leave out what is no feature, turn percent texts and Y/N flags into numbers, fill counts with 0."""
    df = panel.drop(*drop).withColumns({
        **{c: parse_percent(F.col(c)) for c in percents}, **{c: yes_no(F.col(c)) for c in flags},
    })
    return fill_zero(df, zero_fill) if zero_fill else df


def assemble(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Add the vector column; rows with a missing input are left out."""
    return VectorAssembler(inputCols=list(inputs), outputCol=FEATURES, handleInvalid="skip").transform(df)


def baseline(df: DataFrame, value: str, name: str = "predicted") -> DataFrame:
    """Persistence: today's value is the prediction."""
    return df.withColumn(name, F.col(value).cast("double"))


def fit_forest(
    train: DataFrame, target: str, inputs: Sequence[str], trees: int = 500, depth: int = 8, seed: int = 0, bootstrap: bool = True,
    inputs_per_split: str = "auto",
) -> RandomForestRegressionModel:
    """Without ``bootstrap``, and with ``inputs_per_split`` all, one tree is the plain regression tree of all rows.

    Spark ML's fit visits every row for every tree and level. Where rows have few different inputs, sums decide the same cuts
    from one visit (``operators/forest.py``); the forest has as many trees, as deep, and every row is drawn for each.
    """
    forest = RandomForestRegressor(featuresCol=FEATURES, labelCol=target, predictionCol="predicted", numTrees=trees, maxDepth=depth, seed=seed,
                                   bootstrap=bootstrap, featureSubsetStrategy=inputs_per_split)
    at = places(train, target, inputs, trees, LEAST_ROWS) if inputs_per_split in ("auto", "all", "onethird") else None
    if at is None:
        return forest.fit(assemble(train, inputs))
    one = train.sparkSession.createDataFrame([(0.0, Vectors.dense([0.0] * len(inputs)))], T.StructType().add(target, "double").add(FEATURES, VectorUDT())).coalesce(1)
    return grow_forest(train, target, inputs, at, forest.fit(one), depth, seed, bootstrap, inputs_per_split)


def forest_nodes(model: RandomForestRegressionModel, spark: SparkSession) -> DataFrame:
    """(tree, node, feature, threshold, left, right, prediction): a fitted forest as a table, written and read by the executors.

    A tree starts at node 0. ``feature`` is the place of the input that a node asks for: rows with at most ``threshold`` go
    left. A leaf has feature -1 and is its own child.
    """
    path = scratch_path(spark, "forest")
    model.write().save(path)
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), n["id"].cast("int").alias("node"), F.when(leaf, -1).otherwise(n["split"]["featureIndex"]).cast("int").alias("feature"),
        F.when(~leaf, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(leaf, n["id"]).otherwise(n["leftChild"]).cast("int").alias("left"), F.when(leaf, n["id"]).otherwise(n["rightChild"]).cast("int").alias("right"),
        n["prediction"].alias("prediction"))


def predict_from_nodes(df: DataFrame, nodes: DataFrame, inputs: Sequence[str], depth: int, name: str = "predicted") -> DataFrame:
    """The forest's predictions from its node table alone: the mean over the trees of the leaf a row comes to.

    Each row becomes one short row per tree, which follows its tree level by level through a lookup on (tree, node); the
    mean is taken per task before the shuffle. A row with a missing input has no prediction.
    """
    step = materialize(nodes.select((F.col("tree").cast("long") * (1 << 31) + F.col("node")).alias("_at"), "tree", "feature", "threshold",
                                    *[(F.col("tree").cast("long") * (1 << 31) + F.col(c)).alias(f"_{c}") for c in ("left", "right")], "prediction"))
    trees = step.agg(F.max("tree")).first()[0]
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in inputs])
    whole = rows.select("_row", x.alias("_x")).filter(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    roots = F.transform(F.sequence(F.lit(0), F.lit(trees)), lambda t: t.cast("long") * (1 << 31))
    at = whole.withColumn("_at", F.explode(roots))
    for _ in range(depth):
        met = lookup_join(at, step.select("_at", "feature", "threshold", "_left", "_right"), ["_at"], "inner", limit=FOREST_NODES, derived=False)
        left = (F.col("feature") < 0) | (F.get("_x", F.greatest("feature", F.lit(0))) <= F.col("threshold"))
        at = met.select("_row", "_x", F.when(left, F.col("_left")).otherwise(F.col("_right")).alias("_at"))
    ended = lookup_join(at, step.select("_at", "prediction"), ["_at"], "inner", limit=FOREST_NODES, derived=False)
    return rows.join(ended.groupBy("_row").agg(F.avg("prediction").alias(name)), "_row", "left").drop("_row")


def importances(model: RandomForestRegressionModel, inputs: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance); one row per model input."""
    rows = [(n, float(v)) for n, v in zip(inputs, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def best_feature(table: DataFrame) -> DataFrame:
    return table.agg(F.max_by("feature", "importance").alias("feature"))


def fit_linear(train: DataFrame, target: str, inputs: Sequence[str]):
    return LinearRegression(featuresCol=FEATURES, labelCol=target, predictionCol="predicted",
                            solver="normal").fit(assemble(train, inputs))


def predict(model, df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """``df`` with the model's prediction. Where rows have few different inputs, a forest is asked once for each of these."""
    at = places(df, None, inputs, 1) if isinstance(model, RandomForestRegressionModel) else None
    if at is None:
        return model.transform(assemble(df, inputs)).drop(FEATURES)
    names = [f"_x{i}" for i in range(len(inputs))]
    asked = df.sparkSession.createDataFrame(at.tolist(), ", ".join(f"{n} double" for n in names))
    known = F.broadcast(model.transform(assemble(asked, names)).drop(FEATURES))
    met = [F.col(f"`{c}`").cast("double") == F.col(n) for c, n in zip(inputs, names)]
    return df.join(known, met, "inner").drop(*names)


def ols_one(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Intercept and slope per group from one aggregate, over the rows that have both values."""
    df = without_nan(df, [y, x])
    return df.groupBy(*by).agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def ols_two(df: DataFrame, y: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares on two predictors per group: the normal equations solved from second moments."""
    df = df.dropna("any", subset=[y, a, b])
    m = df.groupBy(*by).agg(
        F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab"),
        F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by_"),
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    m = m.withColumns({
        "slope_a": F.try_divide(F.col("ay") * F.col("bb") - F.col("by_") * F.col("ab"), det),
        "slope_b": F.try_divide(F.col("by_") * F.col("aa") - F.col("ay") * F.col("ab"), det),
    })
    return m.select(
        *by, (F.col("my") - F.col("slope_a") * F.col("ma") - F.col("slope_b") * F.col("mb")).alias("intercept"),
        "slope_a", "slope_b",
    )


def fit_gamma_glm(train: DataFrame, target: str, inputs: Sequence[str], max_iter: int = 50):
    """Gamma regression with log link."""
    return GeneralizedLinearRegression(
        family="gamma", link="log", featuresCol=FEATURES, labelCol=target, predictionCol="predicted", maxIter=max_iter, tol=1e-9,
    ).fit(assemble(train.filter(F.col(target) > 0), inputs))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _inverse(gram: pd.Series) -> pd.Series:
    """Pseudo-inverse of each row's small symmetric matrix, given as its upper triangle by rows."""
    out = []
    for g in gram:
        k = int((np.sqrt(8 * len(g) + 1) - 1) / 2)
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = g
        out.append(np.linalg.pinv(full + np.triu(full, 1).T, hermitian=True).tolist())
    return pd.Series(out)


def fit_gamma_groups(
    train: DataFrame, target: str, inputs: Sequence[str], group: str, rounds: int = 50, tol: float = 1e-9
) -> DataFrame:
    """Gamma regression with log link in every group on its own, for any number of groups: (group, term, value,
    converged).

    ``converged`` tells whether the group's last round moved no coefficient by ``tol`` or more.

    With this family and link all weights of the reweighted least squares are 1, so the products of the inputs are summed
    and inverted once per group, and a round sums only inputs times working response. The driver sees one number per
    round, the largest change of a coefficient.
    """
    y = F.col(target).cast("double")
    rows = train.select(group, y.alias("_y"), *[F.col(c).cast("double").alias(c) for c in inputs]).dropna().filter("_y > 0")
    rows = materialize(rows)
    x = [F.lit(1.0), *[F.col(c) for c in inputs]]
    pairs = [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
    fixed = rows.groupBy(group).agg(
        F.array(*[F.sum(p) for p in pairs]).alias("_gram"), F.ln(F.avg("_y")).alias("_start"))
    zeros = [F.lit(0.0)] * len(inputs)
    fit, groups = materialize_counted(
        fixed.select(group, _inverse("_gram").alias("_inverse"), F.array("_start", *zeros).alias("_b")))
    # A group travels as an inverse of k * k and two rows of k numbers.
    small = groups <= SMALL_GROUPS and groups * 8 * (len(x) ** 2 + 2 * len(x)) <= BROADCAST_BYTES

    def step(fit: DataFrame) -> DataFrame:
        # The old fit travels along with the sums, so that a plan of several rounds holds each round once.
        now = fit.select(group, "_inverse", "_b")
        joined = rows.join(F.broadcast(now), group) if small else lookup_join(rows, now, [group], "inner", derived=False)
        eta = weighted_sum(F.array(*x), F.col("_b"))
        joined = joined.withColumn("_z", eta + F.col("_y") / F.exp(eta) - 1)
        sums = joined.groupBy(group).agg(
            F.array(*[F.sum(c * F.col("_z")) for c in x]).alias("_right"),
            F.first("_inverse").alias("_inverse"), F.first("_b").alias("_old"))
        solved = sums.withColumn("_b", F.transform("_inverse", lambda row: weighted_sum(row, F.col("_right"))))
        moved = F.array_max(F.zip_with("_b", "_old", lambda a, b: F.abs(a - b)))
        return solved.select(group, "_inverse", "_b", moved.alias("_moved"))

    for done in range(0, rounds, ROUNDS_AT_ONCE):
        for _ in range(min(ROUNDS_AT_ONCE, rounds - done)):
            fit = step(fit)
        fit = materialize(fit)
        if (fit.agg(F.max("_moved")).first()[0] or 0.0) < tol:
            break
    names = F.array(F.lit("intercept"), *[F.lit(c) for c in inputs])
    calm = F.coalesce(F.col("_moved") < tol, F.lit(False)).alias("converged")
    return fit.select(group, calm, F.explode(F.arrays_zip(names.alias("term"), F.col("_b").alias("value"))).alias("_t")).select(
        group, "_t.term", "_t.value", "converged")


def score_increment(
    df: DataFrame, by_outer: DataFrame, by_inner: DataFrame, outer: str, inner: str, inputs: Sequence[str],
    extra: str, previous: str, name: str = "mu",
) -> DataFrame:
    """mu = previous + exp(inputs . betas[outer] + gamma[outer] + extra * tau[inner]).

    ``by_outer`` holds (outer, betas array, gamma), ``by_inner`` (inner, tau). The increment is an exponential, so
    the score never falls below ``previous``.
    """
    joined = lookup_join(lookup_join(df, by_outer, [outer], "inner"), by_inner, [inner], "inner")
    x = F.array(*[F.col(c).cast("double") for c in inputs])
    line = weighted_sum(x, F.col("betas")) + F.col("gamma") + F.col(extra) * F.col("tau")
    return joined.withColumns({"increment": F.exp(line), name: F.col(previous) + F.exp(line)}).drop(
        "betas", "gamma", "tau")


def score_linear(df: DataFrame, params: DataFrame, group: str, inputs: Sequence[str], name: str = "mu") -> DataFrame:
    """mu = inputs . betas[group] + alpha; ``params`` holds (group, betas array, alpha)."""
    joined = lookup_join(df, params, [group], "inner")
    x = F.array(*[F.col(c).cast("double") for c in inputs])
    return joined.withColumn(name, weighted_sum(x, F.col("betas")) + F.col("alpha")).drop("betas", "alpha")


def score_gamma(df: DataFrame, mu: str, phi: str | float) -> DataFrame:
    """Shape and rate of the predictive distribution."""
    p = F.lit(float(phi)) if isinstance(phi, (int, float)) else F.col(phi)
    alpha, beta = gamma_params(F.col(mu), p)
    return df.withColumns({"alpha": alpha, "beta": beta})


def score_draws(
    df: DataFrame, draws: DataFrame, group: str, inputs: Sequence[str], previous: str, probs: dict[str, float],
    mean: str = "y_mean", row_bytes: int = DRAW_ROW_BYTES, lookup_rows: int | None = None,
) -> DataFrame:
    """Score every row under every posterior draw of its group, and summarise over the draws: mean and exact quantiles.

    ``draws`` has (draw, group, betas array, gamma). The draws are a side table of blocks of about ``row_bytes``; a row meets
    the blocks of its group one by one and never holds all of them. Three passes over (row, block): sums and range; counts
    in ``DRAW_BINS`` bins of the range, which tell the bins of the wanted ranks; and counts by value inside these. Only sums
    and counts are shuffled, combined per task before. Scores rise with the linear term, so that is what is ranked.

    A row with a missing input, or without a draw, has NULL results; a draw with a missing number is left out, and rows
    that repeat are summarised each.
    """
    size = max(1, row_bytes // (8 * (len(inputs) + 2)))
    whole = draws.filter(F.col("gamma").isNotNull() & ~F.isnan("gamma") & F.forall("betas", lambda b: b.isNotNull() & ~F.isnan(b)) & (F.size("betas") == len(inputs)))
    # Draws of a group are numbered by hash, not by place, so that no group is in one task; blocks hold about ``size``.
    counted = whole.groupBy(group).agg(F.count(F.lit(1)).alias("_draws"))
    block = F.pmod(F.xxhash64("draw"), F.ceil(F.col("_draws") / size))
    dealt = lookup_join(whole, counted, [group], "inner").select(F.col(group).alias("_g"), block.alias("_block"), F.struct("betas", "gamma").alias("_d"))
    blocks = materialize(dealt.groupBy("_g", "_block").agg(F.collect_list("_d").alias("_ds")).drop("_block"))

    x = F.array(*[F.col(c).cast("double") for c in inputs])
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    fit = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("_prev").isNotNull() & ~F.isnan("_prev")
    points = rows.select("_row", F.col(group).alias("_g"), x.alias("_x"), F.col(previous).cast("double").alias("_prev")).filter(fit)

    def met(side: DataFrame) -> DataFrame:
        """Each row with the linear terms under a block's draws."""
        line = F.transform("_ds", lambda d: weighted_sum(F.col("_x"), d["betas"]) + d["gamma"])
        return lookup_join(side, blocks, ["_g"], "inner", limit=lookup_rows, derived=False).withColumn("_lines", line)

    total = F.aggregate("_lines", F.lit(0.0), lambda acc, t: acc + F.exp(t))
    spans = met(points).groupBy("_row").agg(
        F.sum(F.size("_lines")).alias("_n"), F.sum(total).alias("_sum"), F.min(F.array_min("_lines")).alias("_lo"), F.max(F.array_max("_lines")).alias("_hi"))
    known = materialize(points.join(spans, "_row"))
    places = [F.expr(f"(_n - 1) * {float(p)!r}D") for p in probs.values()]
    ranks = F.array_distinct(F.array(*[f(c).cast("bigint") for c in places for f in (F.floor, F.ceil)]))

    def bin_of(t: Column) -> Column:
        share = F.try_divide(t - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        return F.least(F.coalesce(F.floor(share * DRAW_BINS), F.lit(0)), F.lit(DRAW_BINS - 1)).cast("int")

    upto = Window.partitionBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def holding(counts: DataFrame, order: str, before: Column) -> DataFrame:
        """Counted bins or values (at most the draws of a row) that hold a wanted rank; those ranks, and the rows before them."""
        ended = counts.withColumn("_end", before + F.sum("_count").over(upto.orderBy(order)))
        begin = F.col("_end") - F.col("_count")
        return ended.withColumn("_hit", F.filter("_ranks", lambda r: (r >= begin) & (r < F.col("_end")))).filter(F.size("_hit") > 0).withColumn("_begin", begin)

    by_bin = met(known).select("_row", "_n", F.explode(F.transform("_lines", bin_of)).alias("_bin")).groupBy("_row", "_n", "_bin").agg(F.count(F.lit(1)).alias("_count"))
    open_bins = holding(by_bin.withColumn("_ranks", ranks), "_bin", F.lit(0)).groupBy("_row").agg(
        F.collect_list(F.struct("_bin", "_begin", "_hit")).alias("_open"))
    narrowed = materialize(known.join(open_bins, "_row"))
    inside = F.flatten(F.transform("_lines", lambda t: F.transform(F.filter("_open", lambda o: o["_bin"] == bin_of(t)), lambda o: F.struct(
        o["_bin"].alias("_bin"), o["_begin"].alias("_first"), o["_hit"].alias("_ranks"), t.alias("_line")))))
    values = met(narrowed).select("_row", "_n", "_prev", "_sum", F.explode(inside).alias("_v")).select("_row", "_n", "_prev", "_sum", "_v.*")
    by_value = values.groupBy("_row", "_bin", "_line").agg(F.count(F.lit(1)).alias("_count"), *[F.first(c).alias(c) for c in ("_n", "_prev", "_sum", "_first", "_ranks")])
    upto = Window.partitionBy("_row", "_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = holding(by_value, "_line", F.col("_first")).select("_row", "_n", "_prev", "_sum", F.explode("_hit").alias("_rank"), (F.col("_prev") + F.exp("_line")).alias("_score"))
    out = {mean: F.max(F.col("_prev") + F.col("_sum") / F.col("_n"))}
    for name, place in zip(probs, places):
        low, high = (F.max(F.when(F.col("_rank") == f(place), F.col("_score"))) for f in (F.floor, F.ceil))
        out[name] = low + (high - low) * F.max(place - F.floor(place))
    summary = found.groupBy("_row").agg(*[c.alias(n) for n, c in out.items()])
    return rows.join(summary, "_row", "left").drop("_row")
