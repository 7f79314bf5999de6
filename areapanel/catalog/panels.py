"""Window operators over the years of an area."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import PANEL_CTE, WIDE_CTE, panel, query, rounded, table, wide_counts
from areapanel.operators import panel as ops

W = "OVER (PARTITION BY area ORDER BY year)"


def _short(spark, sf):
    return panel(spark, sf).select("area", "year", "n")


def _gappy(spark, sf):
    """The panel without the years an area skips, so that rows and calendar years differ."""
    return _short(spark, sf).filter((F.col("area") + F.col("year")) % 4 != 0)


GAPPY = PANEL_CTE + ", gappy AS (SELECT area, year, n FROM panel WHERE (area + year) % 4 <> 0)"


@query("F-1", f"WITH {GAPPY} SELECT area, year, n, lag(n, 1) {W} AS n_lag1, lag(n, 2) {W} AS n_lag2 FROM gappy")
def lag_by_row(spark, sf):
    return ops.panel_lag(ops.panel_lag(_gappy(spark, sf), "n", 1, "n_lag1"), "n", 2, "n_lag2")


@query("F-1", f"""
WITH {GAPPY} SELECT p.area, p.year, p.n, q.n AS n_lag2 FROM gappy p LEFT JOIN gappy q ON q.area = p.area AND q.year = p.year - 2""")
def lag_by_calendar(spark, sf):
    return ops.panel_lag(_gappy(spark, sf), "n", 2, "n_lag2", mode="calendar")


@query("F-2", f"WITH {PANEL_CTE} SELECT area, year, n, n - lag(n) {W} AS change FROM panel")
def first_difference(spark, sf):
    return ops.panel_diff(_short(spark, sf), "n", "change")


@query("F-3", f"""
WITH {PANEL_CTE} SELECT area, year, n, round(1 - lag(n) {W} / n::DOUBLE, 10) AS growth, round(n::DOUBLE / lag(n) {W} - 1, 10) AS growth_usual FROM panel""")
def growth(spark, sf):
    out = ops.growth_forward(ops.growth_back(_short(spark, sf), "n", "growth"), "n", "growth_usual")
    return out.withColumns(rounded(10, "growth", "growth_usual"))


@query("F-4", f"""
WITH {PANEL_CTE}
SELECT area, round((1 - arg_min(n, year) / arg_max(n, year)::DOUBLE) / (max(year) - min(year)), 10) AS growth FROM panel GROUP BY 1 HAVING max(year) > min(year)""")
def growth_overall(spark, sf):
    return ops.growth_overall(_short(spark, sf), "n", "growth").withColumns(rounded(10, "growth"))


@query("F-5", f"""
WITH {PANEL_CTE}, m AS (SELECT *, row_number() {W} AS a, row_number() OVER (PARTITION BY area ORDER BY year DESC) AS z FROM panel)
SELECT area, year, n FROM m WHERE a = 1 OR z = 1""")
def first_and_last(spark, sf):
    return ops.first_last(_short(spark, sf))


@query("F-6", f"WITH {PANEL_CTE} SELECT area, year, n, CAST(sum(n) {W} AS BIGINT) AS total FROM panel")
def running_total(spark, sf):
    return ops.running_total(_short(spark, sf), "n", "total")


@query("F-6", """
SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM orders""")
def running_total_large_groups(spark, sf):
    """Three groups hold all orders: the sum runs over slices, never in one task."""
    from areapanel.operators.scale import running_sum

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey")
    out = running_sum(o, ["o_orderstatus"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], "o_custkey", "total", one_task_rows=0)
    return out.select("o_orderkey", "total")


@query("F-7", f"""
WITH {GAPPY}
SELECT area, year, n, round((n::DOUBLE / first_value(n) OVER w - 1) * 100, 8) AS increase, first_value(year) OVER w AS frame_start
FROM gappy WINDOW w AS (PARTITION BY area ORDER BY year RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def increase_over_frame(spark, sf):
    return ops.cum_increase(_gappy(spark, sf), "n", "increase", 3).withColumns(rounded(8, "increase"))


@query("F-8", f"""
WITH {PANEL_CTE}
SELECT area, year, n, round(avg(n) OVER (PARTITION BY area), 8) AS mean_n, round(stddev_samp(n) OVER (PARTITION BY area), 8) AS sd_n,
  CAST(sum(n) OVER (PARTITION BY area) AS BIGINT) AS sum_n FROM panel""")
def group_stats_on_rows(spark, sf):
    out = ops.with_group_stats(_short(spark, sf), ["area"], {
        "mean_n": F.avg("n"), "sd_n": F.stddev_samp("n"), "sum_n": F.sum("n")})
    return out.withColumns(rounded(8, "mean_n", "sd_n"))


RATES = """rates AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, (count(*) % 7 - 2) / 100.0::DOUBLE AS rate FROM orders GROUP BY 1)"""


def _rates(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return o.select("year", ((F.col("n") % 7 - 2) / 100).alias("rate"))


@query("F-9", f"""
WITH {RATES}
SELECT year, round(coalesce(product(1 + rate) OVER (ORDER BY year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 10) AS factor FROM rates""")
def deflator(spark, sf):
    return ops.deflator(_rates(spark, sf)).withColumns(rounded(10, "factor"))


@query("F-10 F-9", f"""
WITH {PANEL_CTE}, {RATES},
f AS (SELECT year, coalesce(product(1 + rate) OVER (ORDER BY year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS factor FROM rates)
SELECT area, p.year, round(price * factor, 4) AS price_adj, round(income * factor, 4) AS income_adj FROM panel p LEFT JOIN f ON f.year = p.year""")
def deflate(spark, sf):
    out = ops.deflate(panel(spark, sf), {"price": "price_adj", "income": "income_adj"}, ops.deflator(_rates(spark, sf)))
    return out.select("area", "year", "price_adj", "income_adj").withColumns(rounded(4, "price_adj", "income_adj"))


@query("F-12", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS INTEGER) AS code FROM customer""")
def factor_codes(spark, sf):
    from areapanel.operators.reshape import factor_code

    return factor_code(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "code")


@query("F-12", """
SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) AS INTEGER) AS code FROM (SELECT DISTINCT p_name FROM part)""")
def factor_dictionary(spark, sf):
    from areapanel.operators.reshape import factor_levels

    return factor_levels(table(spark, sf, "part"), "p_name", one_task_rows=0)


@query("F-13", f"""
WITH {PANEL_CTE}, s AS (SELECT area, year, 1.0::DOUBLE AS base, price / 1000000 AS lin FROM panel)
SELECT area, year, round(base + sum(exp(lin)) {W}, 8) AS mu FROM s""")
def forecast_roll(spark, sf):
    s = panel(spark, sf).select("area", "year", F.lit(1.0).alias("base"), F.exp(F.col("price") / 1000000).alias("step"))
    return ops.forecast_roll(s, "base", "step", "mu").select("area", "year", F.round("mu", 8).alias("mu"))


@query("F-14", f"""
WITH RECURSIVE {PANEL_CTE},
g AS (SELECT area, year, n::DOUBLE AS v, 1 - lag(n) {W} / n::DOUBLE AS g FROM panel),
path AS (SELECT area, CAST(year + 1 AS INTEGER) AS year, round_even(g * v + v, 0) AS v, g, 1 AS i FROM g WHERE year = 2000 AND g IS NOT NULL
  UNION ALL SELECT area, year + 1, round_even(g * v + v, 0), g, i + 1 FROM path WHERE i < 8)
SELECT area, year, v AS forecast FROM path""")
def compound_forecast(spark, sf):
    g = ops.growth_back(_short(spark, sf), "n", "g").filter("year = 2000 AND g IS NOT NULL")
    out = ops.compound_forecast(g, "n", {"g": "forecast"}, 8)
    return out.select("area", "year", "forecast")


@query("F-15", f"""
WITH {PANEL_CTE} SELECT area, year, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, area) AS rank FROM panel""")
def rank_within_year(spark, sf):
    return ops.rank_areas(_short(spark, sf), "n")


@query("F-15", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def rank_large_groups(spark, sf):
    """All orders ranked within seven years, over slices."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return ops.rank_areas(o, "o_totalprice", area="o_orderkey", one_task_rows=0).select("o_orderkey", "year", "rank")


@query("B-25 B-26 F-1", f"""
WITH {WIDE_CTE}
SELECT area, year, round(ln(lag(NB) {W} + 1.001), 8) AS nb_lag1, round(ln(lag(A1) {W} + 1.001), 8) AS a1_lag1,
  round(ln(lag(A2) {W} + 1.001), 8) AS a2_lag1, round(ln(lag(DM / land) {W} + 1.001), 8) AS dm_lag1, round(ln(lag(DM / land, 2) {W} + 1.001), 8) AS dm_lag2
FROM wide""")
def permit_lags(spark, sf):
    from areapanel.plans.permits import permit_lags as lags

    cols = ["nb_lag1", "a1_lag1", "a2_lag1", "dm_lag1", "dm_lag2"]
    return lags(wide_counts(spark, sf)).select("area", "year", *cols).withColumns(rounded(8, *cols))
