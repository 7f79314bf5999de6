"""Joins, windows, shapes and models on small frames with the awkward cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from areapanel.operators import aggregates, filters, joins, models, panel, reshape, sampling


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_count_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", None)], "k string, v int")
    assert rows(aggregates.count_by(df, ["k"]), "k") == [("a", 2)]
    assert len(aggregates.count_by(df, ["k"], drop_null_keys=False).collect()) == 2


def test_not_value_keeps_nulls(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    assert {r.k for r in filters.not_value(df, "k", "x").collect()} == {"y", None}


def test_enrich_guards_row_count(spark):
    left = spark.createDataFrame([(1, 2000), (2, 2000)], "area int, year int")
    twice = spark.createDataFrame([(1, 2000, 5), (1, 2000, 6)], "ZIP int, Y int, v int")
    with pytest.raises(joins.DuplicateKeys):
        joins.enrich(left, twice, {"area": "ZIP", "year": "Y"}, expect_unique=True)
    once = twice.filter("v = 5")
    assert rows(joins.enrich(left, once, {"area": "ZIP", "year": "Y"}, expect_unique=True), "area") == [(1, 2000, 5), (2, 2000, None)]


def test_complete_grid_size_and_zeroes(spark):
    counts = spark.createDataFrame([(1, 2000, "A", 3), (9, 2000, "A", 1), (1, 1999, "A", 4)], "area int, year int, t string, count long")
    areas = spark.createDataFrame([(1,), (2,), (2,)], "area int")
    grid = joins.complete_grid(counts, areas, {"year": [2000, 2001], "t": ["A", "B"]})
    assert grid.count() == 2 * 2 * 2
    assert {(r.area, r.year, r.t): r["count"] for r in grid.collect()}[(1, 2000, "A")] == 3
    assert grid.agg(F.sum("count")).first()[0] == 3


def test_neighbor_avg_edge_cases(spark):
    p = spark.createDataFrame(
        [(1, 2000, 10.0), (2, 2000, None), (3, 2000, 4.0), (4, 2000, 1.0)], "area int, year int, v double")
    adj = spark.createDataFrame([(1, "2, 3, 99"), (2, "98"), (3, "1,4"), (4, "2")], "area int, adjacent string")
    got = {r.area: r.m for r in joins.neighbor_avg(p, adj, {"v": "m"}).collect()}
    assert got == {1: 4.0, 2: None, 3: 5.5, 4: None}
    strict = {r.area: r.m for r in joins.neighbor_avg(p, adj, {"v": "m"}, strict=True).collect()}
    assert strict[1] is None and strict[3] == 5.5
    with pytest.raises(joins.DuplicateKeys):
        joins.neighbor_avg(p.unionByName(p), adj, {"v": "m"})


def test_patch_and_missing_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert rows(joins.patch(df, "k", {2: "z"}, "v"), "v") == [(1, "a"), (None, "c"), (2, "z")]
    assert joins.patch(df, "k", {}, "v") is df
    known = spark.createDataFrame([(1,)], "k int")
    assert rows(joins.missing_keys(df, known, ["k"]), "k") == [(2,)]


def test_lag_modes_over_a_gap(spark):
    df = spark.createDataFrame([(1, 2001, 5), (1, 2002, 6), (1, 2004, 8)], "area int, year int, v int")
    by_row = {r.year: r.x for r in panel.panel_lag(df, "v", 1, "x").collect()}
    by_year = {r.year: r.x for r in panel.panel_lag(df, "v", 1, "x", mode="calendar").collect()}
    assert by_row == {2001: None, 2002: 5, 2004: 6}
    assert by_year == {2001: None, 2002: 5, 2004: None}
    with pytest.raises(ValueError):
        panel.panel_lag(df, "v", 1, "x", mode="other")


def test_growth(spark):
    df = spark.createDataFrame([(1, 2000, 4.0), (1, 2001, 5.0), (1, 2004, None), (2, 2000, 3.0)], "area int, year int, v double")
    assert {r.year: r.g for r in panel.growth_back(df.filter("area=1"), "v", "g").collect()} == {2000: None, 2001: pytest.approx(0.2), 2004: None}
    assert rows(panel.growth_overall(df, "v", "g"), "area") == [(1, pytest.approx(0.2))]
    assert panel.first_last(df).count() == 3


def test_running_total_ends_at_the_sum(spark):
    df = spark.createDataFrame([(1, y, y - 1990) for y in range(2000, 2010)], "area int, year int, v int")
    out = rows(panel.running_total(df, "v", "t"), "year")
    assert out[-1][3] == sum(r[2] for r in out)


def test_increase_starts_at_first_row_found(spark):
    df = spark.createDataFrame([(1, 2008, 100.0), (1, 2010, 150.0), (1, 2020, 300.0)], "area int, year int, v double")
    got = {r.year: (r.inc, r.frame_start) for r in panel.cum_increase(df, "v", "inc", 10).collect()}
    assert got == {2008: (0.0, 2008), 2010: (50.0, 2008), 2020: (100.0, 2010)}


def test_deflator_with_negative_rate(spark):
    df = spark.createDataFrame([(2001, 0.1), (2002, -0.5), (2003, 0.2)], "year int, rate double")
    got = {r.year: r.factor for r in panel.deflator(df).collect()}
    assert got == {2001: pytest.approx(0.6), 2002: pytest.approx(1.2), 2003: 1.0}


def test_cpi_factors(spark):
    from areapanel.plans.features import CPI_CHANGE, cpi_factors

    got = {r.year: r.factor for r in cpi_factors(spark).collect()}
    assert got[2001] == pytest.approx(math.prod(1 + r for r in CPI_CHANGE))
    assert got[2015] == 1.0 and got[2014] == pytest.approx(1.001) and len(got) == 15


def test_forecast_roll_equals_a_loop(spark):
    df = spark.createDataFrame([(1, y, 2.0, math.exp(y / 1000)) for y in range(2018, 2026)], "area int, year int, b double, s double")
    mu = 2.0
    for r in panel.forecast_roll(df, "b", "s", "mu").orderBy("year").collect():
        mu += math.exp(r.year / 1000)
        assert r.mu == pytest.approx(mu)


def test_compound_forecast_equals_a_loop(spark):
    df = spark.createDataFrame([(1, 2016, 40.0, 0.1, -0.05)], "area int, year int, v double, g double, o double")
    got = panel.compound_forecast(df, "v", {"g": "a", "o": "b"}, 4).orderBy("year").collect()
    a = b = 40.0
    for i, r in enumerate(got):
        a, b = float(round(0.1 * a + a)), float(round(-0.05 * b + b))
        assert (r.year, r.a, r.b) == (2017 + i, a, b)


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2000, 0.5), (2, 2000, 0.9), (3, 2000, 0.5), (4, 2000, None)], "area int, year int, p double")
    for limit in (None, 0):
        assert {r.area: r["rank"] for r in panel.rank_areas(df, "p", one_task_rows=limit).collect()} == {2: 1, 1: 2, 3: 3, 4: 4}


def test_earliest_keeps_ties_and_dedupe_takes_first(spark):
    df = spark.createDataFrame([(1, "2010-01-01", 2), (1, "2010-01-01", 1), (1, "2011-01-01", 0), (None, "2000-01-01", 9)], "e int, d string, o int")
    assert aggregates.earliest(df, "e", "d").count() == 2
    assert rows(aggregates.dedupe_first(df.filter("e = 1"), ["e", "d"], [F.col("o")]), "d") == [(1, "2010-01-01", 1), (1, "2011-01-01", 0)]


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([(1, 2000, "A", 2), (1, 2000, "B", 3), (2, 2000, "A", 1), (None, 2000, "A", 7)], "area int, year int, t string, n int")
    wide = reshape.pivot_counts(df, ["area", "year"], "t", ["A", "B"], "n")
    assert rows(wide, "area") == [(1, 2000, 2, 3), (2, 2000, 1, 0)]
    assert rows(reshape.pivot_counts(df, ["area", "year"], "t", ["A", "B"], "n", fill=None), "area")[1] == (2, 2000, 1, None)
    assert reshape.unpivot_periods(wide, ["area", "year"]).count() == 4


def test_normalize(spark):
    df = spark.createDataFrame(
        [("d", 1, "2016-08", 2.0), ("d", 2, "2016-08", 4.0), ("d", 1, "2016-09", 3.0), ("e", 1, "2016-09", 3.0)],
        "dataset string, area int, month string, value double")
    by_max = {(r.dataset, r.area, r.month): r.value_norm for r in reshape.normalize_by_group_max(df, "dataset", "month", "2016-08", "value").collect()}
    assert by_max == {("d", 1, "2016-08"): 0.5, ("d", 2, "2016-08"): 1.0, ("d", 1, "2016-09"): 0.75}
    own = {(r.dataset, r.area, r.month): r.value_norm for r in reshape.normalize_by_base(df, ["dataset", "area"], "month", "2016-08", "value").collect()}
    assert own[("d", 1, "2016-09")] == 1.5 and own[("e", 1, "2016-09")] is None


def test_grid_over_the_values_of_a_frame(spark):
    from areapanel.operators import joins

    counts = spark.createDataFrame([(1, y, 1) for y in range(1500)], "area int, year int, count int")
    areas = spark.createDataFrame([(1,), (2,), (None,)], "area int")
    grid = joins.complete_grid(counts, areas, {"year": counts})
    assert grid.count() == 3000 and grid.agg({"count": "sum"}).first()[0] == 1500


def test_missing_and_infinite_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, nan, None)] + [("b", v) for v in (inf, -inf, 5.0, 6.0, inf)] + [("c", nan)],
                               "g string, v double")
    from areapanel.operators import distribution

    for limit in (0, 10**9):
        got = {r.g: (r.lo, r.mid, r.hi) for r in distribution.quantile_by(df, ["g"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}, one_task_rows=limit).collect()}
        assert got == {"a": (1.0, 2.0, 3.0), "b": (-inf, 6.0, inf)}, limit
    described = {r.g: r for r in distribution.describe_by(df, ["g"], "v").collect()}
    assert (described["a"]["count"], described["a"].mean, described["a"].max) == (3, 2.0, 3.0) and "c" not in described
    assert [r["count"] for r in distribution.histogram(df.filter("g = 'a'"), "v", 2).orderBy("bin").collect()] == [1, 2]
    assert distribution.box_stats(df.filter("g = 'a'"), ["g"], "v").first().outliers == 0
    assert distribution.box_outliers(df.filter("g = 'a'"), ["g"], "v").count() == 0
    from areapanel.operators import aggregates

    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (nan, 1.0)], "y double, p double")
    row = aggregates.metrics(flat, "y", "p").first()
    assert row.n == 2 and row.mse == 1.0 and row.performance is None and row.r2 is None


def test_split_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(i if i % 10 else None,) for i in range(100)], "k int")
    train, test = reshape.split_by_share(df, "k", 0.8)
    assert train.count() + test.count() == 100


def test_earliest_keeps_ties(spark):
    from areapanel.operators import aggregates

    df = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 3, "c"), (2, 9, "d"), (None, 1, "e"), (3, None, "f")], "k int, day int, v string")
    assert sorted(r.v for r in aggregates.earliest(df, "k", "day").collect()) == ["a", "b", "d"]


def test_draws_by_keys_with_spaces(spark):
    from areapanel.operators import sampling

    df = spark.createDataFrame([(10453, 2.0, 1.0)], "`Zip Code` int, s double, r double")
    assert sampling.gamma_draws(df, ["Zip Code"], "s", "r", 5, 1).select("Zip Code").distinct().first()[0] == 10453


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.uniform(1, 9, 50), rng.uniform(1, 9, 50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    m = aggregates.metrics(df, "y", "p").first()
    assert m.mse == pytest.approx(((y - p) ** 2).mean())
    assert m.mape == pytest.approx(np.abs((y - p) / y).mean() * 100)
    assert m.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert m.performance == pytest.approx(1 - abs((p - y).mean()) / (y.max() - y.min()))
    wide = aggregates.metrics(df, "y", "p", (F.lit(20.0), F.lit(0.0))).first()
    assert wide.performance == pytest.approx(1 - abs((p - y).mean()) / 20)


def test_ols_two_against_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=80), rng.normal(size=80)
    y = 3 + 2 * a - b + rng.normal(size=80) / 10
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(y, a, b)], "y double, a double, b double")
    beta = np.linalg.lstsq(np.c_[np.ones(80), a, b], y, rcond=None)[0]
    r = models.ols_two(df, "y", "a", "b").first()
    assert [r.intercept, r.slope_a, r.slope_b] == pytest.approx(list(beta))


def test_gamma_glm_recovers_coefficients(spark):
    rng = np.random.default_rng(4)
    a = rng.uniform(-1, 1, 3000)
    g = np.where(np.arange(3000) % 2 == 0, "p", "q")
    mu = np.exp(np.where(g == "p", 1 + 0.5 * a, -0.5 - 0.8 * a))
    y = rng.gamma(20, mu / 20)
    df = spark.createDataFrame([(float(u), float(v), str(w)) for u, v, w in zip(y, a, g)], "y double, a double, g string")
    fitted = models.fit_gamma_groups(df, "y", ["a"], "g").collect()
    got = {(r.g, r.term): r.value for r in fitted}
    assert all(r.converged for r in fitted)
    assert not any(r.converged for r in models.fit_gamma_groups(df, "y", ["a"], "g", rounds=2).collect())
    expect = {("p", "intercept"): 1, ("p", "a"): 0.5, ("q", "intercept"): -0.5, ("q", "a"): -0.8}
    for k, v in expect.items():
        assert got[k] == pytest.approx(v, abs=0.05)
    whole = models.fit_gamma_glm(df.filter("g = 'p'"), "y", ["a"])
    assert whole.intercept == pytest.approx(got["p", "intercept"], abs=1e-6)


def test_forest_finds_the_input_that_matters(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (400, 2))
    df = spark.createDataFrame([(float(10 * r[0]), float(r[0]), float(r[1])) for r in x], "y double, a double, b double")
    model = models.fit_forest(df, "y", ["a", "b"], trees=10, depth=4)
    table = models.importances(model, ["a", "b"], df)
    assert models.best_feature(table).first().feature == "a"
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert models.predict(model, df, ["a", "b"]).columns == ["y", "a", "b", "predicted"]


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(a, 2010 + a, 9.0, 2.0, 4.0 + a) for a in range(5)], "area int, year int, shape double, rate double, lam double")
    a = rows(sampling.gamma_draws(df.coalesce(1), ["area", "year"], "shape", "rate", 25_000, 3), "area", "draw_no")
    b = rows(sampling.gamma_draws(df.repartition(5), ["area", "year"], "shape", "rate", 25_000, 3), "area", "draw_no")
    assert a == b and len(a) == 125_000 and len({r[3] for r in a}) == 125_000
    values = np.array([r[3] for r in a])
    assert values.mean() == pytest.approx(4.5, abs=0.02) and values.var() == pytest.approx(2.25, abs=0.05)
    years = list(range(2018, 2418))
    p = rows(sampling.poisson_draws(df, {"lam": "n"}, ["area"], years, 1), "area", "year")
    assert p == rows(sampling.poisson_draws(df.repartition(3), {"lam": "n"}, ["area"], years, 1), "area", "year")
    for area in range(5):
        n = np.array([r[2] for r in p if r[0] == area])
        assert n.mean() == pytest.approx(4 + area, abs=0.6) and n.var() == pytest.approx(4 + area, rel=0.35)


def test_poisson_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2000.0), (3, None), (4, 1e6)], "area int, lam double")
    got = {r.area: r.n for r in sampling.poisson_draws(df, {"lam": "n"}, ["area"], [2018], 1).collect()}
    assert got[1] == 0 and 1700 < got[2] < 2300 and got[3] is None and 990_000 < got[4] < 1_010_000


def test_score_draws_summary(spark):
    draws = spark.createDataFrame([(d, 1, [0.1 * d], -1.0) for d in range(11)], "draw int, g int, betas array<double>, gamma double")
    df = spark.createDataFrame([(7, 1, 2.0, 5.0)], "area int, g int, x double, prev double")
    r = models.score_draws(df, draws, "g", ["x"], "prev", {"med": 0.5}).first()
    scores = [5 + math.exp(0.2 * d - 1) for d in range(11)]
    assert r.y_mean == pytest.approx(sum(scores) / 11) and r.med == pytest.approx(scores[5])
