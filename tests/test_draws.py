"""Scores under many posterior draws against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areapanel.operators import models

NAN = float("nan")
PROBS = {"p00": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("row_bytes,lookup_rows", [(400, None), (40, 0)])
def test_mean_and_quantiles(spark, row_bytes, lookup_rows):
    rng = random.Random(4)
    draws = [(d, g, [rng.gauss(0, 0.2), rng.choice([0.0, 0.5])], rng.gauss(-1, 0.3)) for g in "ab" for d in range(300)]
    draws += [(d, "same", [1.0, 1.0], 0.0) for d in range(50)] + [(0, "one", [0.1, 0.2], 0.3)]
    bad = [(900, "a", [None, 1.0], 0.0), (901, "a", [1.0, 1.0], NAN), (902, "a", [1.0], 0.0), (903, "a", [1.0, 1.0], None), (904, "none", [1.0, NAN], 0.0)]
    rows = [(i, rng.choice(["a", "b", "same", "one"]), rng.random(), rng.gauss(0, 2), rng.random() * 3) for i in range(40)]
    odd = [(100, "a", None, 0.0, 1.0), (101, "a", 1.0, NAN, 1.0), (102, "b", 1.0, 1.0, None), (103, "none", 1.0, 1.0, 1.0), (104, None, 1.0, 1.0, 1.0), (105, "a", 0.5, 0.5, 0.5), (105, "a", 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows + odd, "id int, g string, x double, z double, prev double").repartition(3)
    table = spark.createDataFrame(draws + bad, "draw int, g string, betas array<double>, gamma double").repartition(4)
    out = models.score_draws(df, table, "g", ["x", "z"], "prev", PROBS, row_bytes=row_bytes, lookup_rows=lookup_rows)
    assert out.columns == [*df.columns, "y_mean", *PROBS]
    got = out.collect()
    assert len(got) == len(rows + odd)
    for r in got:
        scores = [r.prev + np.exp(r.x * b[0] + r.z * b[1] + c) for _, g, b, c in draws if g == r.g] if r.id not in (100, 101, 102) else []
        if not scores:
            assert r.y_mean is None and all(r[n] is None for n in PROBS)
        else:
            assert r.y_mean == pytest.approx(np.mean(scores), rel=1e-12)
            assert [r[n] for n in PROBS] == pytest.approx(np.quantile(scores, list(PROBS.values())), rel=1e-12)


def test_no_row_holds_all_draws(spark, monkeypatch):
    """What is written out stays below one kilobyte a row, with 4,000 draws of 7 inputs."""
    seen = []
    real = models.materialize
    monkeypatch.setattr(models, "materialize", lambda df: seen.append(real(df)) or seen[-1])
    draws = spark.range(4000).select(F.col("id").alias("draw"), F.lit("g").alias("g"), F.array(*[F.rand(i) / 10 for i in range(7)]).alias("betas"), F.rand(9).alias("gamma"))
    df = spark.range(3).select("id", F.lit("g").alias("g"), F.lit(1.0).alias("prev"), *[F.lit(i / 7.0).alias(f"x{i}") for i in range(7)])
    out = models.score_draws(df, draws, "g", [f"x{i}" for i in range(7)], "prev", {"p": 0.9})
    assert out.count() == 3 and len(seen) >= 4
    for table in seen:
        sizes = [F.size(c) * 64 for c, kind in table.dtypes if c == "_ds"]
        assert all(table.agg(F.max(s)).first()[0] <= 1024 for s in sizes)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id int, g string, x double, prev double")
    draws = spark.createDataFrame([], "draw int, g string, betas array<double>, gamma double")
    assert models.score_draws(df, draws, "g", ["x"], "prev", {"p": 0.5}).count() == 0
    one = spark.createDataFrame([(1, "g", 1.0, 1.0)], df.schema)
    assert models.score_draws(one, draws, "g", ["x"], "prev", {"p": 0.5}).first().p is None
