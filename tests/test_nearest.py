"""The members' tree: bounded leaves and few pairs wherever members lie, and exact distances."""

import math
import random

import pytest
from pyspark.sql import functions as F

from areapanel.operators import nearest
from areapanel.operators.nearest import candidate_pairs, member_tree, nearest_in_set

SHAPES = {
    "even": lambda r: (r.random(), r.random()),
    "far": lambda r: (r.random(), r.random()),
    "line": lambda r: (r.random(), 0.0),
    "diagonal": lambda r: (lambda t: (t, t))(r.random()),
    "clusters": lambda r: (lambda c: (r.gauss(c, 1e-6), r.gauss(-c, 1e-6)))(r.choice([0, 1, 5, 1e6])),
}


def frame(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "g string, x double, y double")


@pytest.mark.parametrize("shape", SHAPES)
def test_pairs_met_and_distances(spark, shape):
    rng = random.Random(5)
    members = [SHAPES[shape](rng) for _ in range(1500)] + ([(1e12, 1e12)] if shape == "far" else [])
    points = [(rng.random(), rng.random()) for _ in range(400)] + members[:20] + [(1e13, -3.0)]
    m, p = frame(spark, members), frame(spark, points)
    pairs = candidate_pairs(p, m, ["g"], "x", "y")
    assert pairs.count() <= 100 * len(points)
    got = {(r.x, r.y): r.proximity for r in nearest_in_set(p, m, ["g"], "x", "y").collect()}
    for x, y in points:
        assert got[x, y] == pytest.approx(min(math.hypot(x - a, y - b) for a, b in members), rel=1e-9, abs=1e-12)


def test_tree_is_the_same_when_cut_over_ranges(spark):
    rng = random.Random(6)
    members = frame(spark, [(rng.choice([0.0, 1.0, rng.random()]), rng.random()) for _ in range(700)] + [(1e12, 0.0)])
    trees = [member_tree(members, ["g"], "x", "y", 4, limit) for limit in (None, 50)]
    assert trees[0][1] == trees[1][1] > 1
    rows = [sorted((r._mx, r._my, r._node) for r in t.collect()) for t, _ in trees]
    assert rows[0] == rows[1]
    assert trees[0][0].groupBy("_node").count().agg(F.max("count")).first()[0] <= 4


def test_places_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    points = [(1, "a", 0.0, 0.0), (2, "a", nan, 0.0), (3, "a", inf, 0.0), (4, None, 0.0, 0.0), (5, "a", None, 1.0), (6, "b", 0.0, 0.0)]
    members = [("a", 3.0, 4.0), ("a", nan, 0.0), ("a", 0.0, -inf), (None, 0.0, 0.0), ("a", None, 0.0)]
    got = nearest_in_set(spark.createDataFrame(points, "id int, g string, x double, y double"),
                         spark.createDataFrame(members, "g string, x double, y double"), ["g"], "x", "y")
    assert {r.id: r.proximity for r in got.collect()} == {1: 5.0, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_few_pairs_where_one_coordinate_spans_far_more(spark):
    rng = random.Random(7)
    columns = [(rng.random() * 5e5, float(y)) for _ in range(250) for y in range(12)]
    members = [*((x, y * 8 % 97) for x, y in columns), (1e12, -1e12)]
    points = [(rng.random() * 5e5, float(rng.randrange(97))) for _ in range(300)]
    m, p = frame(spark, members), frame(spark, points)
    assert candidate_pairs(p, m, ["g"], "x", "y").count() <= 100 * len(points)
    for lookup_rows in (None, 0):
        got = {(r.x, r.y): r.proximity for r in nearest_in_set(p, m, ["g"], "x", "y", lookup_rows=lookup_rows).collect()}
        for x, y in points:
            assert got[x, y] == pytest.approx(min(math.hypot(x - a, y - b) for a, b in members), rel=1e-9)


def test_points_are_not_shuffled_where_members_can_be_sent(spark):
    rng = random.Random(8)
    points = frame(spark, [(rng.random(), rng.random()) for _ in range(100)])
    plan = nearest_in_set(points, points.limit(40), ["g"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "ArrowEvalPython" in plan


@pytest.mark.parametrize("members_sent, nodes_sent", [(10_000, 0), (0, 10_000), (0, 100), (0, 0)])
def test_search_in_pieces(spark, monkeypatch, members_sent, nodes_sent):
    """Few places and nodes at a time, groups of any size, all members about as near, and squares that are infinite or nought."""
    monkeypatch.setattr(nearest, "SENT_MEMBERS", members_sent)
    monkeypatch.setattr(nearest, "SENT_NODES", nodes_sent)
    monkeypatch.setattr(nearest, "PLACES_AT_ONCE", 7)
    monkeypatch.setattr(nearest, "NODES_AT_ONCE", 5)
    rng = random.Random(9)
    members = [("ring", math.cos(i / 50), math.sin(i / 50)) for i in range(300)] + [("two", 1.0, 1.0), ("two", -1.0, 1.0)]
    members += [("huge", s * 10.0**e, 1.0) for s in (-1, 1) for e in range(140, 309)] + [("tiny", 10.0**-e, 0.0) for e in range(140, 300)]
    points = [(g, rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for g in ("ring", "two", "none") for _ in range(20)]
    points += [("huge", s * 10.0**e, 0.0) for s in (-1, 1) for e in range(135, 309, 6)] + [("tiny", 3 * 10.0**-e, 0.0) for e in range(135, 300, 6)]
    schema = "g string, x double, y double"
    got = nearest_in_set(spark.createDataFrame(points, schema), spark.createDataFrame(members, schema), ["g"], "x", "y").collect()
    assert len(got) == len(points)
    for r in got:
        near = [math.sqrt((r.x - x) * (r.x - x) + (r.y - y) * (r.y - y)) for g, x, y in members if g == r.g]
        assert r.proximity == (min(near) if near else None)


def test_levels_that_can_be_sent_are_descended_at_once(spark):
    rng = random.Random(10)
    members = frame(spark, [(rng.random(), rng.random()) for _ in range(700)])
    places = members.limit(50).select("g", members.x.alias("_qx"), members.y.alias("_qy"))
    tree, depth = member_tree(members, ["g"], "x", "y", 4)
    for lookup_rows, level in ((None, depth), (20, 1), (0, 0)):
        front, sent = nearest._front(places, tree, depth, ["g"], lookup_rows)
        assert sent == level and front.select("_qx", "_qy").distinct().count() == 50
        own = tree.selectExpr("g", "_mx AS _qx", "_my AS _qy", f"_node div {16 ** (depth - sent)} AS _node")
        assert front.join(own, ["g", "_qx", "_qy", "_node"], "left_semi").count() == 50  # each is its own nearest
