"""Feature tables, fits, scores and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import AREAS_CTE, PANEL_CTE, WIDE_CTE, areas, panel, query, rounded, table, wide_counts
from areapanel.functions.numeric import annualize
from areapanel.functions.probability import gamma_params, gamma_tail
from areapanel.operators import aggregates, models, sampling


@query("H-1", """
SELECT l_orderkey, l_linenumber, l_discount * 100 AS discount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
  coalesce(CASE WHEN l_linestatus = 'O' THEN l_tax END, 0) AS tax FROM lineitem""")
def feature_table(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.concat((F.col("l_discount") * 100).cast("string"), F.lit("%")).alias("discount"),
        F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("returned"),
        F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("tax"))
    return models.feature_table(li, ["l_quantity"], ["discount"], ["returned"], ["tax"])


@query("H-2 D-13 E-20", f"""
WITH {PANEL_CTE}, t AS (SELECT p.price AS p, q.price AS y FROM panel p JOIN panel q ON q.area = p.area AND q.year = p.year + 2)
SELECT count(*) AS n, round(sum((y - p) * (y - p)) / count(*), 2) AS mse, round(avg(abs((y - p) / y)) * 100, 8) AS mape,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(1 - abs(avg(p - y)) / (max(y) - min(y)), 8) AS performance FROM t""")
def persistence_baseline(spark, sf):
    from areapanel.operators.joins import with_value_at

    t = with_value_at(panel(spark, sf).select("area", "year", "price"), "price", 2, "actual")
    m = aggregates.metrics(models.baseline(t, "price"), "actual", "predicted")
    return m.withColumns(rounded(2, "mse") | rounded(8, "mape", "performance") | rounded(6, "r2"))


@query("H-4", """
SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope
FROM lineitem GROUP BY 1""")
def ols_one(spark, sf):
    out = models.ols_one(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.withColumns(rounded(4, "intercept") | rounded(5, "slope"))


OLS_TWO = """m AS (SELECT {by} var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
  avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t {group}),
s AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS sa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS sb FROM m)
SELECT {by} round(my - sa * ma - sb * mb, 3) AS intercept, round(sa, 4) AS slope_a, round(sb, 2) AS slope_b FROM s"""


@query("H-4", f"""
WITH t AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem),
{OLS_TWO.format(by="g,", group="GROUP BY g")}""")
def ols_two(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return models.ols_two(li, "y", "a", "b", ["g"]).withColumns(rounded(3, "intercept") | rounded(4, "slope_a") | rounded(2, "slope_b"))


@query("H-4", f"""
WITH t AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem),
{OLS_TWO.format(by="", group="")}""")
def linear_fit(spark, sf):
    """The solver's coefficients equal the normal equations'."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    model = models.fit_linear(li, "y", ["a", "b"])
    row = (float(model.intercept), *[float(v) for v in model.coefficients.toArray()])
    out = spark.createDataFrame([row], "intercept double, slope_a double, slope_b double")
    return out.withColumns(rounded(3, "intercept") | rounded(4, "slope_a") | rounded(2, "slope_b"))


@query("H-7 H-8", f"""
WITH {PANEL_CTE}, {AREAS_CTE},
x AS (SELECT p.area, p.year, a.borough, p.price / 100000 AS prev, p.income / 10000 AS x1, p.income / 100000 AS x2, ln(p.n) AS crime FROM panel p JOIN areas a ON a.area = p.area),
s AS (SELECT *, prev + exp(x1 * (0.1::DOUBLE * borough) + x2 * (0.05::DOUBLE * borough + 0.2::DOUBLE) + (-1.0::DOUBLE - borough / 10.0::DOUBLE) + crime * (0.01::DOUBLE * (area % 5))) AS mu FROM x)
SELECT area, year, round(mu, 8) AS mu, round(mu * mu / 0.5::DOUBLE, 6) AS alpha, round(mu / 0.5::DOUBLE, 8) AS beta FROM s""")
def score_increment(spark, sf):
    a = areas(spark, sf)
    x = panel(spark, sf).join(a.select("area", "borough"), "area").select(
        "area", "year", "borough", (F.col("area") % 5).alias("neighborhood"), (F.col("price") / 100000).alias("prev"),
        (F.col("income") / 10000).alias("x1"), (F.col("income") / 100000).alias("x2"), F.ln("n").alias("crime"))
    b = F.col("borough")
    outer = a.select("borough").distinct().select(
        "borough", F.array(b * 0.1, b * 0.05 + 0.2).alias("betas"), (F.lit(-1.0) - b / 10).alias("gamma"))
    inner = a.select((F.col("area") % 5).alias("neighborhood")).distinct().withColumn("tau", F.col("neighborhood") * 0.01)
    mu = models.score_increment(x, outer, inner, "borough", "neighborhood", ["x1", "x2"], "crime", "prev")
    out = models.score_gamma(mu, "mu", 0.5).select("area", "year", "mu", "alpha", "beta")
    return out.withColumns(rounded(8, "mu", "beta") | rounded(6, "alpha"))


@query("H-9", f"""
WITH {PANEL_CTE}, {AREAS_CTE}
SELECT p.area, p.year, round(p.n * (0.1::DOUBLE * borough) + p.income / 1000 * 0.5::DOUBLE + borough * 2.0::DOUBLE, 8) AS mu
FROM panel p JOIN areas a ON a.area = p.area""")
def score_linear(spark, sf):
    a = areas(spark, sf)
    x = panel(spark, sf).join(a.select("area", "borough"), "area").withColumn("income", F.col("income") / 1000)
    b = F.col("borough")
    params = a.select("borough").distinct().select("borough", F.array(b * 0.1, F.lit(0.5)).alias("betas"), (b * 2.0).alias("alpha"))
    out = models.score_linear(x, params, "borough", ["n", "income"])
    return out.select("area", "year", F.round("mu", 8).alias("mu"))


@query("H-10", f"""
WITH {PANEL_CTE}, {AREAS_CTE},
d AS (SELECT b.borough, k.draw, 0.001::DOUBLE * (b.borough + k.draw) AS beta, -1.0::DOUBLE - k.draw / 50.0::DOUBLE AS gamma
  FROM (SELECT DISTINCT borough FROM areas) b CROSS JOIN (SELECT unnest(range(100)) AS draw) k),
s AS (SELECT p.area, p.year, p.price / 100000 + exp(p.income / 1000 * d.beta + d.gamma) AS mu FROM panel p JOIN areas a ON a.area = p.area JOIN d ON d.borough = a.borough)
SELECT area, year, round(avg(mu), 8) AS y_mean, round(quantile_cont(mu, 0.05), 8) AS p05, round(quantile_cont(mu, 0.95), 8) AS p95 FROM s GROUP BY 1, 2""")
def score_over_draws(spark, sf):
    a = areas(spark, sf)
    draws = a.select("borough").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99)))).select(
        "draw", "borough", F.array((F.col("borough") + F.col("draw")) * 0.001).alias("betas"), (F.lit(-1.0) - F.col("draw") / 50).alias("gamma"))
    x = panel(spark, sf).join(a.select("area", "borough"), "area").withColumns(
        {"prev": F.col("price") / 100000, "income": F.col("income") / 1000})
    out = models.score_draws(x, draws, "borough", ["income"], "prev", {"p05": 0.05, "p95": 0.95})
    return out.select("area", "year", "y_mean", "p05", "p95").withColumns(rounded(8, "y_mean", "p05", "p95"))


MANY_DRAWS = 4000
MANY_INPUTS = [f"x{i}" for i in range(1, 8)]


@query("H-10", f"""
WITH {PANEL_CTE}, {AREAS_CTE},
x AS (SELECT p.area, p.year, a.borough, p.price / 100000 AS prev, {", ".join(f"(p.area * {i} + p.year * {8 - i}) % 17 / 10.0::DOUBLE AS x{i}" for i in range(1, 8))}
  FROM panel p JOIN areas a ON a.area = p.area),
d AS (SELECT b.borough, k.draw, {", ".join(f"((k.draw * {13 + 10 * i} + b.borough * 7) % 1009 - 504) / 4000.0::DOUBLE AS b{i}" for i in range(1, 8))}, -1.0::DOUBLE - k.draw % 50 / 50.0::DOUBLE AS gamma
  FROM (SELECT DISTINCT borough FROM areas) b CROSS JOIN (SELECT unnest(range({MANY_DRAWS})) AS draw) k),
s AS (SELECT area, year, prev + exp({" + ".join(f"x{i} * b{i}" for i in range(1, 8))} + gamma) AS mu FROM x JOIN d ON d.borough = x.borough)
SELECT area, year, round(avg(mu), 8) AS y_mean, round(quantile_cont(mu, 0.025), 8) AS p025, round(quantile_cont(mu, 0.5), 8) AS p50, round(quantile_cont(mu, 0.975), 8) AS p975
FROM s GROUP BY 1, 2""")
def score_over_many_draws(spark, sf):
    """Four thousand draws of seven coefficients for each borough."""
    a = areas(spark, sf)
    b, k = F.col("borough"), F.col("draw")
    draws = a.select("borough").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(MANY_DRAWS - 1)))).select(
        "draw", "borough", F.array(*[((k * (13 + 10 * i) + b * 7) % 1009 - 504) / 4000.0 for i in range(1, 8)]).alias("betas"), (F.lit(-1.0) - k % 50 / 50).alias("gamma"))
    x = panel(spark, sf).join(a.select("area", "borough"), "area").select(
        "area", "year", "borough", (F.col("price") / 100000).alias("prev"),
        *[((F.col("area") * i + F.col("year") * (8 - i)) % 17 / 10.0).alias(f"x{i}") for i in range(1, 8)])
    out = models.score_draws(x, draws, "borough", MANY_INPUTS, "prev", {"p025": 0.025, "p50": 0.5, "p975": 0.975})
    return out.select("area", "year", "y_mean", "p025", "p50", "p975").withColumns(rounded(8, "y_mean", "p025", "p50", "p975"))


@query("H-11", f"""
WITH {PANEL_CTE}, g AS (SELECT area, year, price / 100000 AS mu, (price / 100000) * (1 + (area - 12) / 40.0::DOUBLE) AS threshold FROM panel),
p AS (SELECT area, year, mu * mu / 0.05::DOUBLE AS a, mu / 0.05::DOUBLE * threshold AS z FROM g),
c AS (SELECT area, year, least(1.0, sum(exp((a + k) * ln(z) - z - lgamma(a + k + 1)))) AS cdf
  FROM p CROSS JOIN (SELECT unnest(range(600)) AS k) t GROUP BY 1, 2)
SELECT area, year, round(1 - cdf, 7) AS probability FROM c""")
def gamma_tail_probability(spark, sf):
    g = panel(spark, sf).select("area", "year", (F.col("price") / 100000).alias("mu"))
    a, b = gamma_params(F.col("mu"), F.lit(0.05))
    threshold = F.col("mu") * ((F.col("area") - 12) / 40 + 1)
    return g.select("area", "year", F.round(gamma_tail(threshold, a, b), 7).alias("probability"))


@query("H-12 J-3")
def gamma_draws(spark, sf):
    g = panel(spark, sf).select("area", "year", (F.col("price") / 100000).alias("mu"))
    a, b = gamma_params(F.col("mu"), F.lit(0.05))
    draws = sampling.gamma_draws(g.withColumns({"a": a, "b": b}), ["area", "year"], "a", "b", 100_000, seed=11)
    return draws.groupBy("area", "year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("draw"), 6).alias("mean"), F.round(F.var_samp("draw"), 6).alias("variance"))


@query("H-13 E-10", f"""
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS c1, quantile_cont(o_totalprice, 0.8) AS c2 FROM orders GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_totalprice >= c1 THEN 1 ELSE 0 END + CASE WHEN o_totalprice >= c2 THEN 1 ELSE 0 END AS interval
FROM orders JOIN q USING (o_orderpriority)""")
def quantile_intervals(spark, sf):
    from areapanel.operators.distribution import quantile_by, quantile_cut
    from areapanel.operators.scale import lookup_join

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    cuts = quantile_by(o, ["o_orderpriority"], "o_totalprice", {"c1": 0.25, "c2": 0.8})
    out = quantile_cut(lookup_join(o, cuts, ["o_orderpriority"]), "o_totalprice", ["c1", "c2"])
    return out.select("o_orderkey", "interval")


@query("H-14", f"""
WITH {PANEL_CTE}, r AS (SELECT area, sum(n) / 80.0::DOUBLE AS rate FROM panel GROUP BY 1),
y AS (SELECT area, rate, unnest([2002, 2003, 2004]) AS year FROM r),
u AS (SELECT *, CAST('0x' || substr(md5('5:' || area::VARCHAR || ':' || year::VARCHAR || ':orders'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM y),
c AS (SELECT area, year, u, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY area, year ORDER BY k) AS cdf
  FROM u CROSS JOIN (SELECT unnest(range(400)) AS k) t)
SELECT area, year, CAST(count(*) FILTER (WHERE cdf < u) AS BIGINT) AS orders FROM c GROUP BY 1, 2""")
def poisson_draws(spark, sf):
    rates = panel(spark, sf).groupBy("area").agg((F.sum("n") / 80).alias("rate"))
    return sampling.poisson_draws(rates, {"rate": "orders"}, ["area"], [2002, 2003, 2004], seed=5)


@query("H-15", f"""
WITH {WIDE_CTE}
SELECT area, year, CASE WHEN year = 2001 THEN round_even(A1 * (1 + 1 / 12.0::DOUBLE), 0) ELSE A1::DOUBLE END AS A1 FROM wide""")
def annualize_partial_year(spark, sf):
    return wide_counts(spark, sf).select("area", "year", annualize(F.col("A1"), F.col("year"), 2001).alias("A1"))


@query("H-15 E-19", f"""
WITH {WIDE_CTE}, f AS (SELECT area, CASE WHEN year = 2001 THEN round_even(A1 * (1 + 1 / 12.0::DOUBLE), 0) ELSE A1::DOUBLE END AS A1,
  CASE WHEN year = 2001 THEN round_even(NB * (1 + 1 / 12.0::DOUBLE), 0) ELSE NB::DOUBLE END AS NB FROM wide WHERE year >= 1997)
SELECT area, round(avg(A1), 8) AS mean_A1, round(stddev_samp(A1), 8) AS sd_A1, round(sum(A1) / 8, 8) AS rate_A1,
  round(avg(NB), 8) AS mean_NB, round(stddev_samp(NB), 8) AS sd_NB, round(sum(NB) / 8, 8) AS rate_NB FROM f GROUP BY 1""")
def permit_rates(spark, sf):
    from areapanel.plans.permits import permit_rates as rates

    cols = [f"{s}_{t}" for t in ("A1", "NB") for s in ("mean", "sd", "rate")]
    return rates(wide_counts(spark, sf), 2001, 1997, ("A1", "NB")).withColumns(rounded(8, *cols))


def _fit_rows(spark, sf):
    """Line items with a positive target and two inputs of moderate size."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") / 10).alias("a"),
        (F.col("l_discount") * 10).alias("b"), F.col("l_returnflag").alias("g"))


@query("H-3")
def forest_importances(spark, sf):
    model = models.fit_forest(_fit_rows(spark, sf), "y", ["a", "b"])
    return models.importances(model, ["a", "b"], _fit_rows(spark, sf)).withColumns(rounded(4, "importance"))


@query("H-3 E-20 G-7")
def forest_test_metrics(spark, sf):
    from areapanel.operators.reshape import split_by_share

    rows = _fit_rows(spark, sf).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    train, test = split_by_share(rows, "id", 0.8)
    model = models.fit_forest(train, "y", ["a", "b"])
    span = rows.agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    scored = models.predict(model, test, ["a", "b"])
    return aggregates.metrics(scored, "y", "predicted", (F.lit(span.select("hi").scalar()), F.lit(span.select("lo").scalar())))


TREE_ROWS = "t AS (SELECT l_discount AS b, l_tax AS c, l_extendedprice / 1000 * (1 + l_discount) * (1 - 3 * l_tax) AS y FROM lineitem)"


def _best_cut(rows: str, part: str) -> str:
    """Per part, the cut between two values of one input that leaves the least squared error."""
    by = f"{part}, " if part else ""
    return f"""SELECT {by}f, v FROM (
  SELECT {by}f, v, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl, sum(n) OVER whole AS n, sum(s) OVER whole AS s FROM (
    SELECT {by}f, v, count(*) AS n, sum(y) AS s FROM (SELECT {by}0 AS f, b AS v, y FROM {rows} UNION ALL SELECT {by}1, c, y FROM {rows}) GROUP BY ALL)
  WINDOW upto AS (PARTITION BY {by}f ORDER BY v), whole AS (PARTITION BY {by}f))
  WHERE nl < n QUALIFY row_number() OVER ({f"PARTITION BY {part} " if part else ""}ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f, v) = 1"""


@query("H-3", f"""
WITH {TREE_ROWS}, one AS ({_best_cut("t", "")}),
t1 AS (SELECT t.*, CASE WHEN CASE WHEN f = 0 THEN b ELSE c END <= v THEN 0 ELSE 1 END AS side FROM t, one),
two AS ({_best_cut("t1", "side")}),
t2 AS (SELECT t1.*, CASE WHEN CASE WHEN f = 0 THEN b ELSE c END <= v THEN 0 ELSE 1 END AS leaf FROM t1 JOIN two USING (side)),
means AS (SELECT side, leaf, avg(y) AS predicted FROM t2 GROUP BY 1, 2)
SELECT DISTINCT b, c, side, leaf, round(predicted, 6) AS predicted FROM t2 JOIN means USING (side, leaf)""")
def regression_tree(spark, sf):
    """A tree of two levels, exported as a table of nodes and followed there; which side a row takes is read from it as well."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("b"), F.col("l_tax").alias("c"), (F.col("l_extendedprice") / 1000 * (F.col("l_discount") + 1) * (F.lit(1) - F.col("l_tax") * 3)).alias("y"))
    model = models.fit_forest(rows, "y", ["b", "c"], trees=1, depth=2, bootstrap=False, inputs_per_split="all")
    nodes = models.forest_nodes(model, spark)
    places = rows.select("b", "c").distinct()
    # Ends are told apart by putting 0 and 1 where the table has predictions.
    root = nodes.filter("node = 0").select(F.col("left").alias("l"), F.col("right").alias("r")).first()
    sides = nodes.withColumn("prediction", (F.col("node") >= root["r"]).cast("double"))
    rights = nodes.filter("feature >= 0 AND node > 0").select(F.col("right").alias("node")).withColumn("is_right", F.lit(1.0))
    leaves = nodes.join(rights, "node", "left").withColumn("prediction", F.coalesce("is_right", F.lit(0.0))).drop("is_right")
    out = models.predict_from_nodes(places, nodes, ["b", "c"], 2)
    out = models.predict_from_nodes(out, sides, ["b", "c"], 2, "side")
    out = models.predict_from_nodes(out, leaves, ["b", "c"], 2, "leaf")
    return out.select("b", "c", F.col("side").cast("int").alias("side"), F.col("leaf").cast("int").alias("leaf"), F.round("predicted", 6).alias("predicted"))


def _irls_two(rounds: int, by: bool) -> str:
    """The same on two inputs: each round solves the normal equations of eta + (y - mu) / mu on both."""
    g, on, group = ("g, ", "USING (g)", "GROUP BY g") if by else ("", "ON true", "")
    ctes = [f"b0 AS (SELECT {g}ln(avg(y)) AS c0, 0.0::DOUBLE AS ca, 0.0::DOUBLE AS cb FROM t {group})"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"z{i} AS (SELECT {g}a, b, eta + (y - exp(eta)) / exp(eta) AS z FROM (SELECT {g}a, b, y, c0 + ca * a + cb * b AS eta FROM t JOIN b{i - 1} {on})), "
            f"s{i} AS (SELECT {g}avg(z) AS mz, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS vab, "
            f"covar_pop(a, z) AS vaz, covar_pop(b, z) AS vbz FROM z{i} {group}), "
            f"d{i} AS (SELECT *, (vaz * vb - vbz * vab) / (va * vb - vab * vab) AS ca, (vbz * va - vaz * vab) / (va * vb - vab * vab) AS cb FROM s{i}), "
            f"b{i} AS (SELECT {g}mz - ca * ma - cb * mb AS c0, ca, cb FROM d{i})")
    return ", ".join(ctes)


TWO_INPUTS = "t AS MATERIALIZED (SELECT l_returnflag AS g, l_extendedprice / 1000 AS y, l_quantity / 10 AS a, l_discount * 10 AS b FROM lineitem)"


@query("H-5", f"""
WITH {TWO_INPUTS}, {_irls_two(14, False)}
SELECT 'intercept' AS term, round(c0, 4) AS value FROM b14 UNION ALL SELECT 'a', round(ca, 4) FROM b14 UNION ALL SELECT 'b', round(cb, 4) FROM b14""")
def gamma_regression(spark, sf):
    model = models.fit_gamma_glm(_fit_rows(spark, sf), "y", ["a", "b"])
    rows = [("intercept", float(model.intercept)), *zip(["a", "b"], map(float, model.coefficients.toArray()))]
    return spark.createDataFrame(rows, "term string, value double").withColumns(rounded(4, "value"))


@query("H-6", f"""
WITH {TWO_INPUTS}, {_irls_two(14, True)}
SELECT g, 'intercept' AS term, round(c0, 4) AS value FROM b14 UNION ALL SELECT g, 'a', round(ca, 4) FROM b14 UNION ALL SELECT g, 'b', round(cb, 4) FROM b14""")
def gamma_regression_by_group(spark, sf):
    return models.fit_gamma_groups(_fit_rows(spark, sf), "y", ["a", "b"], "g").drop("converged").withColumns(rounded(4, "value"))


def _irls(rounds: int, by: bool) -> str:
    """Reweighted least squares of a gamma regression with log link, whose weights are all 1: each round regresses
    eta + (y - mu) / mu on the input."""
    g, on, group = ("g, ", "USING (g)", "GROUP BY g") if by else ("", "ON true", "")
    ctes = [f"b0 AS (SELECT {g}ln(avg(y)) AS c0, 0.0::DOUBLE AS c1 FROM t {group})"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"b{i} AS (SELECT {g}regr_intercept(z, a) AS c0, regr_slope(z, a) AS c1 FROM (SELECT {g}a, "
            f"c0 + c1 * a + (y - exp(c0 + c1 * a)) / exp(c0 + c1 * a) AS z FROM t JOIN b{i - 1} {on}) {group})")
    return ", ".join(ctes)


ONE_INPUT = "t AS (SELECT l_returnflag AS g, l_extendedprice / 1000 AS y, l_quantity / 10 AS a FROM lineitem)"


@query("H-5", f"""
WITH {ONE_INPUT}, {_irls(20, False)}
SELECT 'intercept' AS term, round(c0, 4) AS value FROM b20 UNION ALL SELECT 'a', round(c1, 4) FROM b20""")
def gamma_regression_one_input(spark, sf):
    model = models.fit_gamma_glm(_fit_rows(spark, sf), "y", ["a"])
    rows = [("intercept", float(model.intercept)), ("a", float(model.coefficients[0]))]
    return spark.createDataFrame(rows, "term string, value double").withColumns(rounded(4, "value"))


@query("H-6", f"""
WITH {ONE_INPUT}, {_irls(20, True)}
SELECT g, 'intercept' AS term, round(c0, 4) AS value FROM b20 UNION ALL SELECT g, 'a', round(c1, 4) FROM b20""")
def gamma_regression_one_input_by_group(spark, sf):
    return models.fit_gamma_groups(_fit_rows(spark, sf), "y", ["a"], "g").drop("converged").withColumns(rounded(4, "value"))


@query("H-6", f"""
WITH {PANEL_CTE}, t AS (SELECT CAST(area AS INTEGER) AS g, price / 100000 AS y, n / 100.0::DOUBLE AS a FROM panel),
{_irls(20, True)}
SELECT g AS area, 'intercept' AS term, round(c0, 5) AS value FROM b20 UNION ALL SELECT g, 'a', round(c1, 5) FROM b20""")
def gamma_regression_per_area(spark, sf):
    rows = panel(spark, sf).select("area", (F.col("price") / 100000).alias("y"), (F.col("n") / 100).alias("a"))
    return models.fit_gamma_groups(rows, "y", ["a"], "area").drop("converged").withColumns(rounded(5, "value"))
