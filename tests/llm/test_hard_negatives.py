"""Hard negatives against all scores, with hot directions, ties and odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areapanel.llm import hard_negatives as hn

INF = float("inf")


def brute(rows, every=10, positives=5, negatives=5, low=80):
    kept = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(256 * float(x)) for x in v])
        kept[i] = min(kept.get(i, own), own)
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, (l, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            fits = [(t, i) for t, i, l in scores if l != label and low * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def made(n, width, seed, labels=4, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, draw.randrange(labels), [draw.gauss(c, spread) for c in draw.choice(centres)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", 1) for r in rows], "vec_id long, label int, embedding array<double>, block string, cell int").repartition(3)


def found(spark, rows, every=10, **sizes):
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "pack": 3, "slice_packs": 2, "cells": 6, "step": 4}])
def test_negatives_equal_brute_force(spark, sizes):
    rows = made(400, 6, 1)
    assert found(spark, rows, **sizes) == brute(rows) != []


def test_odd_rows(spark):
    rows = made(120, 3, 2) + [(None, 1, [1.0] * 3), (1000, None, [1.0] * 3), (1010, 1, None), (1020, 1, [1.0, None, 1.0]), (1030, 1, [1.0, INF, 0.0]),
                              (1040, 2, [float("nan")] * 3), (1050, 1, []), (1060, 1, [0.0] * 3), (1070, 0, [2.0]), (1080, 1, [1e7, -1e7, 3e6]), (1090, 0, [1.0, 1.0, 1.0, 9.0]),
                              (-10, 1, [1.0, 0.5, 0.25]), (0, 3, [0.0, 1.0, 0.0]), (20, 0, [-9.0, 0.0, 0.0])]
    assert found(spark, rows, block=20, pack=4, cells=4) == brute(rows)


def test_ties_and_a_direction_that_holds_a_third(spark):
    rows = made(150, 4, 3) + [(200 + i, i % 3, [1.0, 2.0, 0.0, 1.0]) for i in range(200)] + [(500 + i, 1, [1.0, 2.0, 0.0, 1.0]) for i in range(60)]
    assert found(spark, rows, block=16, pack=4, slice_packs=2, step=8) == brute(rows)


def test_few_rows(spark):
    none = frame(spark, made(3, 2, 0)).limit(0)
    assert hn.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    assert found(spark, [(10, 1, [1.0, 0.0])]) == []
    no_anchor = made(9, 2, 0)[1:]
    assert found(spark, no_anchor) == []
    two = [(10, 1, [1.0, 0.0]), (11, 1, [1.0, 0.0]), (12, 0, [0.9, 0.0])]
    assert found(spark, two) == brute(two) == [(10, 11, 1, 12, 65536, 230 * 256)]


def test_products_are_exact_at_any_size():
    a, b = np.array([[1 << 30, 3]]), np.array([[1 << 30, 5], [-(1 << 30), 1]])
    assert hn.products(a, b).tolist() == [[(1 << 60) + 15, -(1 << 60) + 3]]
    assert hn.products(a << 20, b << 20).tolist() == [[hn.HIGHEST, hn.LOWEST]]


def test_a_walk_ends_early_and_is_exact():
    draw = np.random.default_rng(0)
    rows, ids, labels = (draw.normal(size=(4000, 8)) * 100).astype(np.int64), np.arange(4000), np.zeros(4000, int)
    own = rows[:1] * 2 + draw.integers(-30, 30, (6, 8))
    centre = hn.directions(hn.directions(own)[1].sum(axis=0)[None])[1][0]
    anything = [[hn.LOWEST]] * 6, [[hn.HIGHEST]] * 6
    got, formed = hn.walk(own, np.arange(-6, 0), labels[:6], *anything, centre, rows, ids, labels, True, 5, 64)
    scores = own @ rows.T
    assert sorted(got) == sorted((u - 6, 0, int(i), int(scores[u, i])) for u in range(6) for i in np.lexsort((ids, -scores[u]))[:5])
    assert formed < 6 * 4000 / 2


def test_query_equals_sql(spark, sf):
    from areapanel.llm.queries import QUERIES, SQL
    from oracle import compare, connect

    assert compare(QUERIES["op12_hard_negatives"](spark, sf), connect(sf), SQL["op12_hard_negatives"]) is None
