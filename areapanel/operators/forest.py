"""A random forest of rows that have few different inputs, grown from sums.

What decides a cut is how many rows a tree drew at each place, which is a combination of input values, and the sums of
their targets and squared targets. So rows are read once: each draws how often every tree takes it, tasks add up per tree and place,
and each tree is grown by a task from its own sums, of which there are at most ``PLACES``. The trees are those of Spark ML's rules,
but a cut between any two values of an input is looked at, where Spark ML looks at 31 per input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.operators.scale import scratch_path

# Different inputs that rows may have, and these times the number of trees: a task's sums take 24 bytes for each.
PLACES = 4_096
SUMS = 2_000_000
# With fewer rows, a tree might draw none.
LEAST_ROWS = 100
# Rows that a task takes at a time, and draws made at a time.
ROWS_AT_ONCE = 65_536
DRAWS_AT_ONCE = 1_000_000

SUM_SCHEMA = "tree int, place array<int>, n array<double>, total array<double>, squares array<double>"
NODE_SCHEMA = ("tree int, id int, prediction double, impurity double, n double, total double, squares double, gain double, "
               "left int, right int, feature int, threshold double")


def places(rows: DataFrame, target: str | None, inputs: Sequence[str], trees: int, least: int = 1) -> np.ndarray | None:
    """The different inputs of ``rows``, one row each; None if they are too many, or rows too few, or values odd, for sums."""
    if not all(isinstance(rows.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in (*inputs, target) if c):
        return None
    rows = _numbers(rows, target, inputs)
    bound, names = min(PLACES, SUMS // trees), [f"x{i}" for i in range(len(inputs))]
    if rows.agg(F.approx_count_distinct(F.struct(*names))).first()[0] > 1.2 * bound:
        return None
    odd = F.exists(F.array(*names, F.coalesce("y", F.lit(math.nan))), lambda v: F.isnan(v) | (F.abs(v) == math.inf))
    found = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.max(odd).alias("odd")).limit(bound + 1).collect()
    if len(found) > bound or sum(r["n"] for r in found) < least or any(r["odd"] for r in found):
        return None
    return np.array(sorted(tuple(r[c] for c in names) for r in found), float)


def _numbers(train: DataFrame, target: str | None, inputs: Sequence[str]) -> DataFrame:
    """(x0, x1, ..., y) of the rows that have all inputs."""
    x = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(inputs)]
    rows = train.select(*x, (F.col(f"`{target}`").cast("double") if target else F.lit(0.0)).alias("y"))
    return rows.dropna(subset=[f"x{i}" for i in range(len(inputs))])


def _summing(at: np.ndarray, trees: int, seed: int, bootstrap: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums per tree and place of a task's rows. How often a tree takes a row is a Poisson number of mean 1."""
    rows_at_once, step = ROWS_AT_ONCE, max(1, DRAWS_AT_ONCE // trees)
    # A random byte gives the number where 1/256 parts of its probability are whole; the bytes left over draw from the rest.
    odds = 256 * np.array([math.exp(-1) / math.factorial(k) for k in range(20)])
    byte = np.repeat(np.arange(20, dtype=np.uint8), np.floor(odds).astype(int))
    rest = np.cumsum(odds - np.floor(odds))
    rest /= rest[-1]
    values = [np.unique(at[:, i]) for i in range(at.shape[1])]

    def run(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        # Places in order are in the order of their codes; where a code has no place, no row has it.
        codes = np.zeros(len(at), np.int64)
        for i, v in enumerate(values):
            codes = codes * len(v) + np.searchsorted(v, at[:, i])
        table = np.concatenate([byte, np.zeros(256 - len(byte), np.uint8)])
        sums = np.zeros((3, len(at), trees))

        def draws(rows):
            if not bootstrap:
                return np.ones((rows, trees))
            drawn = np.frombuffer(rng.bytes(rows * trees), np.uint8)
            weights = table[drawn]
            left = np.flatnonzero(drawn >= len(byte))
            weights[left] = np.searchsorted(rest, rng.random(len(left)), side="right")
            return weights.reshape(rows, trees).astype(float)

        def add(held):
            x = np.concatenate([np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in held])
            code = np.zeros(len(x), np.int64)
            for i, v in enumerate(values):
                code = code * len(v) + np.searchsorted(v, x[:, i])
            place = np.searchsorted(codes, code)
            order = np.argsort(place, kind="stable")
            place, y = place[order], x[order, -1]
            ends = np.append(np.flatnonzero(np.diff(place)) + 1, len(place))
            lo = 0
            for end in ends.tolist():
                for lo in range(lo, end, step):
                    part = y[lo:min(lo + step, end)]
                    sums[:, place[lo]] += np.vstack([np.ones(len(part)), part, part * part]) @ draws(len(part))
                lo = end

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= rows_at_once:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        drew = sums[0].T > 0
        tree, place = np.nonzero(drew)
        offsets = pa.array(np.append(0, np.cumsum(drew.sum(1))), pa.int32())
        columns = [pa.array(np.arange(trees), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32()))]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(s.T[drew])) for s in sums]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "place", "n", "total", "squares"])

    return run


def _growing(at: np.ndarray, depth: int, seed: int, tried: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A tree's nodes in preorder: at each, the cut that leaves the least squared error, of ``tried`` inputs drawn for it."""
    values = [np.unique(at[:, i]) for i in range(at.shape[1])]

    def grow(key, rows):
        rng = np.random.default_rng([seed, int(key[0]), 1])
        where = np.concatenate(rows["place"].to_list()).astype(np.int64)
        sums = [np.bincount(where, np.concatenate(rows[c].to_list()), len(at)) for c in ("n", "total", "squares")]
        codes = [np.searchsorted(v, at[:, i]) for i, v in enumerate(values)]
        nodes = []

        def impurity(n, total, squares):
            return (squares - total * total / n) / n

        def best_cut(here, n, whole):
            best = (0.0, -1, 0)
            for f in range(len(values)) if tried == len(values) else rng.choice(len(values), tried, replace=False).tolist():
                left = [np.cumsum(np.bincount(codes[f][here], s[here], len(values[f])))[:-1] for s in sums]
                right = [s[here].sum() - x for s, x in zip(sums, left)]
                can = np.flatnonzero((left[0] > 0) & (right[0] > 0))
                if len(can):
                    left, right = [x[can] for x in left], [x[can] for x in right]
                    gain = whole - left[0] / n * impurity(*left) - right[0] / n * impurity(*right)
                    most = int(gain.argmax())
                    if gain[most] > best[0]:
                        best = (float(gain[most]), f, int(can[most]))
            return best

        def add(here, level):
            own, (n, total, squares) = len(nodes), [float(s[here].sum()) for s in sums]
            spread = impurity(n, total, squares)
            gain, f, cut = best_cut(here, n, spread) if level < depth and abs(spread) > 2.3e-16 else (0.0, -1, 0)
            nodes.append([int(key[0]), own, total / n, spread, n, total, squares, -1.0, -1, -1, -1, math.nan])
            if f >= 0:
                goes = codes[f][here] <= cut
                low = add(here[goes], level + 1)
                nodes[own][7:] = [gain, low, add(here[~goes], level + 1), f, (values[f][cut] + values[f][cut + 1]) / 2]
            return own

        add(np.flatnonzero(sums[0] > 0), 0)
        return pd.DataFrame(nodes, columns=["tree", "id", "prediction", "impurity", "n", "total", "squares", "gain", "left", "right", "feature", "threshold"])

    return grow


def grow_forest(
    train: DataFrame, target: str, inputs: Sequence[str], at: np.ndarray, bare: RandomForestRegressionModel, depth: int, seed: int, bootstrap: bool,
    inputs_per_split: str,
) -> RandomForestRegressionModel:
    """The forest of ``train``, whose different inputs are ``at``, as a Spark ML model.

    ``bare`` is a model with the wanted parameters and number of trees; its stored form gets the nodes.
    """
    spark, trees = train.sparkSession, bare.getNumTrees
    tried = len(inputs) if inputs_per_split == "all" or inputs_per_split == "auto" and trees == 1 else -(-len(inputs) // 3)
    # A task writes the sums of all places, so tasks are no more than can run at once.
    rows = _numbers(train, target, inputs).coalesce(spark.sparkContext.defaultParallelism)
    sums = rows.mapInArrow(_summing(at, trees, seed, bootstrap), SUM_SCHEMA)
    nodes = sums.groupBy("tree").applyInPandas(_growing(at, depth, seed, tried), NODE_SCHEMA)
    leaf = F.col("feature") < 0
    node = F.struct(
        "id", "prediction", "impurity", F.array("n", "total", "squares").alias("impurityStats"), F.col("n").cast("long").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split"))
    path = scratch_path(spark, "forest")
    bare.write().save(path)
    nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)
