"""NaN and NULL are one thing for every operator, and rows without a group are a group."""

import math

import pytest
from pyspark.sql import functions as F

from areapanel.operators import aggregates, distribution, joins, missing, models, panel, reshape
from areapanel.operators.scale import group_lookup

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def df(spark):
    rows = [("a", 1, 2001, 2.0, 1.0), ("a", 1, 2002, NAN, 2.0), ("a", 1, 2003, 6.0, NAN), (None, 2, 2001, None, 5.0), (None, 2, 2002, 4.0, 6.0), (None, 3, 2002, 8.0, 4.0), ("b", 4, 2001, NAN, NAN)]
    return spark.createDataFrame(rows, "g string, area int, year int, v double, w double")


def test_known_leaves_other_types_alone(spark):
    one = spark.createDataFrame([(NAN, NAN, 1, "x", [NAN])], "d double, f float, i int, s string, a array<double>")
    assert tuple(missing.without_nan(one).first())[:4] == (None, None, 1, "x")
    assert missing.without_nan(one, ["i"]) is one


def test_aggregates(df):
    assert {r.g: (r.v, r.w) for r in aggregates.sum_by(df, ["g"], ["v", "w"]).collect()} == {"a": (8.0, 3.0), None: (12.0, 15.0), "b": (None, None)}
    assert {r.g: r.m for r in aggregates.avg_by(df, ["g"], "v", "m").collect()} == {"a": 4.0, None: 6.0, "b": None}
    assert tuple(aggregates.max_min(df, {"v": "v"}).first()) == (8.0, 2.0)
    assert tuple(aggregates.bbox(df, "area", "v", "w").filter("area = 1").first()) == (1, 2.0, 6.0, 1.0, 2.0)
    assert aggregates.count_distinct(df, ["v"]).first().v == 4
    line = {r.g: (r.n, r.slope) for r in aggregates.reg_line(df, "v", "w", ["g"]).collect()}
    assert line["a"] == (1, None) and line[None] == (2, -0.5)
    assert {r.g: r.slope for r in models.ols_one(df, "w", "v", ["g"]).collect()}[None] == -0.5
    wide = aggregates.sums_by_category(df, ["area"], "g", "v", ["a", "b"])
    assert {r.area: (r.a, r.b) for r in wide.collect()}[1] == (8.0, 0.0)


def test_windows_and_sorts(df):
    assert [(r.year, r.t) for r in panel.running_total(df, "v", "t").filter("area = 1").orderBy("year").collect()] == [(2001, 2.0), (2002, 2.0), (2003, 8.0)]
    assert [(r.area, r.g) for r in panel.growth_overall(df, "v", "g").collect()] == [(1, pytest.approx(1 / 3))]
    assert {r.area: r.rank for r in panel.rank_areas(df, "v").filter("year = 2002").collect()} == {3: 1, 2: 2, 1: 3}
    assert {(r.area, r.year): r.x for r in panel.growth_back(df, "v", "x").collect()}[1, 2003] is None
    stats = panel.with_group_stats(df, ["g"], {"m": F.avg("v")})
    assert stats.columns == [*df.columns, "m"] and stats.count() == 7
    assert {r.g: r.m for r in stats.collect()} == {"a": 4.0, None: 6.0, "b": None}


def test_groups_without_a_key(df):
    low = distribution.below_group_quantile(df, ["g"], "v", 0.5)
    high = distribution.below_group_quantile(df, ["g"], "v", 0.5, at_or_above=True)
    assert sorted(r.v for r in low.collect()) == [2.0, 4.0] and sorted(r.v for r in high.collect()) == [6.0, 8.0]
    assert sorted(r.v for r in distribution.below_group_quantile(df, [], "v", 0.5, at_or_above=True).collect()) == [6.0, 8.0]
    box = {r.g: (r.q50, r.outliers) for r in distribution.box_stats(df, ["g"], "v").collect()}
    assert box == {"a": (4.0, 0), None: (6.0, 0)}
    norm = {(r.area, r.year): r.value_norm for r in reshape.normalize_by_group_max(df, "g", "year", 2002, "w").collect()}
    assert norm[2, 2002] == 1.0 and norm[3, 2002] == pytest.approx(4 / 6) and norm[1, 2003] is None and (4, 2001) not in norm
    base = {(r.area, r.year): r.value_norm for r in reshape.normalize_by_base(df, ["g", "area"], "year", 2002, "v").collect()}
    assert base[2, 2002] == 1.0 and base[1, 2003] is None


def test_density_of_infinite_values(spark):
    rows = [("a", x) for x in (1.0, 2.0, 4.0, INF, -INF, NAN, None)] + [(None, 0.0), (None, 1.0)]
    got = distribution.kde(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points=32).collect()
    assert {r.g for r in got} == {"a", None} and all(math.isfinite(r.density) and math.isfinite(r.x) for r in got)
    finite = distribution.kde(spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0)], "g string, v double"), ["g"], "v", points=32).collect()
    for r, q in zip(sorted((r.x, r.density) for r in got if r.g == "a"), sorted((r.x, r.density) for r in finite)):
        assert r == pytest.approx(q)


def test_neighbours(spark, df):
    own = df.filter("year = 2002").select("area", "year", "v")
    around = spark.createDataFrame([(1, "2, 3"), (2, "1, 3"), (3, "1")], "area int, adjacent string")
    assert {r.area: r.m for r in joins.neighbor_avg(own, around, {"v": "m"}).collect()} == {1: 6.0, 2: 8.0, 3: None}
    assert {r.area: r.m for r in joins.neighbor_avg(own, around, {"v": "m"}, strict=True).collect()} == {1: 6.0, 2: None, 3: None}


@pytest.mark.parametrize("limit", [None, 0])
def test_group_lookup_on_several_keys(spark, limit):
    left = spark.createDataFrame([(None, 1, "x"), (None, None, "y"), ("k", None, "z"), ("k", 2, "u")], "a string, b int, c string")
    right = spark.createDataFrame([(None, 1, 10), (None, None, 20), ("k", None, 30)], "a string, b int, d int")
    kept = group_lookup(left, right, ["a", "b"], "left", limit=limit)
    assert kept.columns == ["a", "b", "c", "d"] and {r.c: r.d for r in kept.collect()} == {"x": 10, "y": 20, "z": 30, "u": None}
