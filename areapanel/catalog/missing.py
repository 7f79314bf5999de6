"""Every operator that computes with values, over inputs that hold NULL, NaN and rows without a group.

The SQL has NULL in both cases, because the library treats NaN as missing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import AREAS_CTE, PANEL_CTE, areas, panel, query, rounded, table
from areapanel.operators import aggregates, distribution, joins, models, panel as panels, reshape

NAN, UNKNOWN = "(area * 7 + year) % 5 = 0", "(area + year) % 4 = 0"
GAPPED = PANEL_CTE + f""", p AS (SELECT CASE WHEN area % 6 <> 0 THEN CAST(area % 3 AS INTEGER) END AS g, area, year, n,
  CASE WHEN {NAN} OR {UNKNOWN} THEN NULL ELSE n::DOUBLE END AS v, CASE WHEN {UNKNOWN} THEN NULL ELSE n * 2.0::DOUBLE + area END AS w FROM panel)"""


def gapped(spark, sf):
    """(g, area, year, n, v, w): every fifth v is NaN, every fourth v and w is NULL, every sixth area has no g."""
    unknown = F.expr(UNKNOWN)
    return panel(spark, sf).select(
        F.when(F.col("area") % 6 != 0, (F.col("area") % 3).cast("int")).alias("g"), "area", "year", "n",
        F.when(F.expr(NAN), float("nan")).when(~unknown, F.col("n").cast("double")).alias("v"),
        F.when(~unknown, F.col("n") * 2.0 + F.col("area")).alias("w"))


@query("E-5", f"WITH {GAPPED} SELECT area, max(w) AS max_y, max(v) AS max_x, min(w) AS min_y, min(v) AS min_x FROM p GROUP BY 1")
def bounding_box_gaps(spark, sf):
    return aggregates.bbox(gapped(spark, sf), "area", "v", "w")


@query("E-6", f"WITH {GAPPED} SELECT g, sum(v) AS v, sum(w) AS w FROM p GROUP BY 1")
def sums_gaps(spark, sf):
    return aggregates.sum_by(gapped(spark, sf), ["g"], ["v", "w"])


@query("E-8", f"WITH {GAPPED} SELECT area, year, round(avg(v), 8) AS mean FROM p GROUP BY 1, 2")
def yearly_mean_gaps(spark, sf):
    p = gapped(spark, sf).withColumn("month", F.concat(F.col("year").cast("string"), F.lit("-01")))
    return aggregates.yearly_mean(p, "area", "month", "v", "mean").withColumns(rounded(8, "mean"))


@query("E-9", f"WITH {GAPPED} SELECT g, year, round(avg(v), 8) AS v FROM p GROUP BY 1, 2")
def means_gaps(spark, sf):
    return aggregates.avg_by(gapped(spark, sf), ["g", "year"], "v", "v").withColumns(rounded(8, "v"))


@query("E-16", f"""
WITH {GAPPED}, top AS (SELECT g, max(v) AS top FROM p WHERE year = 1998 GROUP BY 1 HAVING max(v) IS NOT NULL)
SELECT p.area, p.year, p.v, round(v / top, 8) AS value_norm FROM p JOIN top ON top.g IS NOT DISTINCT FROM p.g""")
def normalized_by_group_gaps(spark, sf):
    out = reshape.normalize_by_group_max(gapped(spark, sf), "g", "year", 1998, "v")
    return out.select("area", "year", "v", F.round("value_norm", 8).alias("value_norm"))


@query("E-17", f"""
WITH {GAPPED}, own AS (SELECT g, area, max(v) AS base FROM p WHERE year = 1998 GROUP BY 1, 2)
SELECT p.area, p.year, round(v / base, 8) AS value_norm FROM p LEFT JOIN own ON own.g IS NOT DISTINCT FROM p.g AND own.area = p.area""")
def normalized_by_own_gaps(spark, sf):
    out = reshape.normalize_by_base(gapped(spark, sf), ["g", "area"], "year", 1998, "v")
    return out.select("area", "year", F.round("value_norm", 8).alias("value_norm"))


@query("E-21", f"""
WITH {GAPPED} SELECT g, CAST(regr_count(w, v) AS BIGINT) AS n, round(regr_slope(w, v), 8) AS slope, round(regr_intercept(w, v), 6) AS intercept, round(regr_r2(w, v), 8) AS r2 FROM p GROUP BY 1""")
def regression_line_gaps(spark, sf):
    return aggregates.reg_line(gapped(spark, sf), "v", "w", ["g"]).withColumns(rounded(8, "slope", "r2") | rounded(6, "intercept"))


@query("E-26", f"WITH {GAPPED} SELECT max(v) AS max_v, min(v) AS min_v, max(w) AS max_w, min(w) AS min_w FROM p")
def extremes_gaps(spark, sf):
    return aggregates.max_min(gapped(spark, sf), {"v": "v", "w": "w"})


@query("F-4", f"""
WITH {GAPPED} SELECT area, round((1 - arg_min(v, year) / arg_max(v, year)) / (max(year) - min(year)), 10) AS growth
FROM p WHERE v IS NOT NULL GROUP BY 1 HAVING max(year) > min(year)""")
def overall_growth_gaps(spark, sf):
    return panels.growth_overall(gapped(spark, sf), "v", "growth").withColumns(rounded(10, "growth"))


@query("F-6", f"WITH {GAPPED} SELECT area, year, sum(v) OVER (PARTITION BY area ORDER BY year) AS total FROM p")
def running_total_gaps(spark, sf):
    return panels.running_total(gapped(spark, sf), "v", "total").select("area", "year", "total")


@query("F-15", f"WITH {GAPPED} SELECT area, year, row_number() OVER (PARTITION BY year ORDER BY v DESC NULLS LAST, area) AS rank FROM p")
def ranks_gaps(spark, sf):
    return panels.rank_areas(gapped(spark, sf), "v").select("area", "year", "rank")


def _neighbors(mean: str) -> str:
    return f"""
WITH {GAPPED}, {AREAS_CTE}, edges AS (SELECT area, CAST(trim(unnest(string_split(adjacent, ','))) AS INTEGER) AS nbr FROM areas),
m AS (SELECT p.area, p.year, {mean} AS around FROM p JOIN edges e ON e.area = p.area JOIN p q ON q.area = e.nbr AND q.year = p.year GROUP BY 1, 2)
SELECT p.area, p.year, p.v, m.around FROM p LEFT JOIN m ON m.area = p.area AND m.year = p.year"""


@query("D-7", _neighbors("round_even(avg(q.v), 2)"))
def neighbors_nan(spark, sf):
    return joins.neighbor_avg(gapped(spark, sf).select("area", "year", "v"), areas(spark, sf), {"v": "around"})


@query("D-7", _neighbors("CASE WHEN count(q.v) = count(*) THEN round_even(avg(q.v), 2) END"))
def neighbors_nan_strict(spark, sf):
    return joins.neighbor_avg(gapped(spark, sf).select("area", "year", "v"), areas(spark, sf), {"v": "around"}, strict=True)


@query("H-4", f"WITH {GAPPED} SELECT g, round(regr_intercept(w, v), 6) AS intercept, round(regr_slope(w, v), 8) AS slope FROM p GROUP BY 1")
def ols_gaps(spark, sf):
    return models.ols_one(gapped(spark, sf), "w", "v", ["g"]).withColumns(rounded(6, "intercept") | rounded(8, "slope"))


def _cut(sense: str, share: float) -> str:
    return f"""
WITH {GAPPED}, q AS (SELECT g, quantile_cont(v, {share}) AS cut FROM p GROUP BY 1)
SELECT p.g, p.area, p.year, p.v FROM p JOIN q ON q.g IS NOT DISTINCT FROM p.g WHERE p.v {sense} q.cut"""


@query("C-11 E-10", _cut("<", 0.3))
def below_group_quantile_gaps(spark, sf):
    return distribution.below_group_quantile(gapped(spark, sf).select("g", "area", "year", "v"), ["g"], "v", 0.3)


@query("C-11 E-10", _cut(">=", 0.8))
def top_members_gaps(spark, sf):
    return distribution.below_group_quantile(gapped(spark, sf).select("g", "area", "year", "v"), ["g"], "v", 0.8, at_or_above=True)


@query("E-12", f"""
WITH {GAPPED}, q AS (SELECT g, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM p GROUP BY 1),
lim AS (SELECT *, q25 - (q75 - q25) * 1.5 AS lo, q75 + (q75 - q25) * 1.5 AS hi FROM q)
SELECT p.g, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50, round(any_value(q75), 6) AS q75, min(CASE WHEN v BETWEEN lo AND hi THEN v END) AS low_whisker,
  max(CASE WHEN v BETWEEN lo AND hi THEN v END) AS high_whisker, CAST(sum(CASE WHEN v BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM p JOIN lim ON lim.g IS NOT DISTINCT FROM p.g WHERE v IS NOT NULL GROUP BY 1""")
def box_stats_gaps(spark, sf):
    return distribution.box_stats(gapped(spark, sf), ["g"], "v").withColumns(rounded(6, "q25", "q50", "q75"))


@query("F-8 E-19", f"""
WITH {GAPPED}, s AS (SELECT g, count(v) AS known, round(avg(v), 8) AS mean, max(v) AS most FROM p GROUP BY 1)
SELECT p.area, p.year, s.known, s.mean, s.most FROM p JOIN s ON s.g IS NOT DISTINCT FROM p.g""")
def group_stats_gaps(spark, sf):
    out = panels.with_group_stats(gapped(spark, sf), ["g"], {"known": F.count("v"), "mean": F.avg("v"), "most": F.max("v")})
    return out.select("area", "year", "known", F.round("mean", 8).alias("mean"), "most")


@query("E-23", """
WITH v AS (SELECT CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS g, c_acctbal AS v FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 13 <> 0),
s AS (SELECT g, count(*) AS n, min(v) AS mn, max(v) AS mx,
   0.9::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::DOUBLE) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS bw FROM v GROUP BY g),
d AS (SELECT *, mn - bw * 3 AS lo, (mx - mn + bw * 6) / 63 AS step FROM s),
c AS (SELECT v.g, CAST(least(floor((v - lo) / step), 62) AS INTEGER) AS cell, (v - lo) / step AS pos FROM v JOIN d ON d.g IS NOT DISTINCT FROM v.g),
w AS (SELECT g, cell, sum(1 - (pos - cell)) AS w FROM c GROUP BY 1, 2 UNION ALL SELECT g, cell + 1, sum(pos - cell) FROM c GROUP BY 1, 2)
SELECT d.g, CAST(k.point AS INTEGER) AS point, round(lo + step * k.point, 6) AS x,
  round(sum(w.w * exp(-0.5::DOUBLE * pow((k.point - w.cell) * step / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 12) AS density
FROM d JOIN w ON w.g IS NOT DISTINCT FROM d.g CROSS JOIN (SELECT unnest(range(64)) AS point) k GROUP BY d.g, k.point, lo, step""")
def kernel_density_gaps(spark, sf):
    """NULL, NaN and both infinite values lie on no grid; customers without a segment are a group."""
    key = F.col("c_custkey")
    v = F.when(key % 11 == 0, F.lit(None)).when(key % 7 == 0, float("nan")).when(key % 13 == 0, F.when(key % 2 == 0, float("inf")).otherwise(float("-inf"))).otherwise(F.col("c_acctbal"))
    c = table(spark, sf, "customer").select(F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("g"), v.alias("v"))
    return distribution.kde(c, ["g"], "v", points=64).withColumns(rounded(6, "x") | rounded(12, "density"))
