"""Quantiles from a sketch and exact counts, against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from areapanel.operators.distribution import quantile_by

PROBS = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.52, "f": 0.999, "h": 1.0}
INF = float("inf")


def exact(values, p):
    values = sorted(values)
    place = (len(values) - 1) * p
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low if low == high else low + (high - low) * (place - math.floor(place))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [("hot", rng.choice([0.0, 5.0, rng.gauss(0, 3)])) for _ in range(6000)] + [(None, rng.expovariate(1)) for _ in range(1500)]
    out += [("few", float(i)) for i in range(7)] + [("one", 2.5)] + [("wide", rng.gauss(0, 1) * 10 ** rng.randint(-30, 30)) for _ in range(900)]
    out += [("ends", v) for v in [INF] * 40 + [-INF] * 30 + [1.0] * 30] + [("hot", None), ("hot", float("nan")), ("nothing", None)]
    return out


@pytest.mark.parametrize("accuracy", [100, 10_000])
@pytest.mark.parametrize("derived", [False, True])
def test_brackets_equal_sorting(spark, rows, accuracy, derived):
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in quantile_by(df, ["g"], "v", PROBS, one_task_rows=0, accuracy=accuracy, derived=derived).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        for n, p in PROBS.items():
            assert got[g][n] == pytest.approx(exact(values, p), rel=1e-12), (g, n)
    for r in quantile_by(df, ["g"], "v", PROBS).collect():  # the way of few rows
        assert tuple(r)[1:] == pytest.approx(tuple(got[r.g])[1:], rel=1e-12)


def test_whole_table_without_groups(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    out = quantile_by(df, [], "v", {"m": 0.5, "n": 0.9}, one_task_rows=0, accuracy=1000)
    assert tuple(out.first()) == pytest.approx((9999.5, 17999.1)) and out.count() == 1


def test_a_rank_outside_its_bracket_is_an_error(spark):
    df = spark.range(5000).select((F.col("id") % 4999).cast("double").alias("v"))
    with pytest.raises(Exception, match="larger margin"):
        quantile_by(df, [], "v", {"m": 0.5}, one_task_rows=0, accuracy=20, margin=-2).collect()
