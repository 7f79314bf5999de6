"""Labels, probabilities, rankings and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import PANEL_CTE, panel, query, rounded, table
from areapanel.plans import areas as plans

BANDS = """bands AS (SELECT year, quantile_cont(income, 0.4) AS income_low, quantile_cont(income, 2 / 3.0::DOUBLE) AS income_high,
  quantile_cont(price, 0.4) AS house_low, quantile_cont(price, 2 / 3.0::DOUBLE) AS house_high FROM panel GROUP BY 1)"""

LABELS = PANEL_CTE + ", " + BANDS + """, joined AS (
  SELECT p.area, p.year, p.price, s.income AS income_start, s.price AS price_start, b.income_low, b.house_low, b.house_high,
         p.price / s.price - 1 AS increase
  FROM panel p JOIN panel s ON s.area = p.area AND s.year = p.year - 4 JOIN bands b ON b.year = p.year - 4),
tops AS (SELECT year, quantile_cont(increase, 2 / 3.0::DOUBLE) AS top_increase FROM joined GROUP BY 1),
flags AS (SELECT j.*, t.top_increase, income_start < income_low AND price_start < house_low AS eligible, increase > top_increase AS risen,
    price_start * (top_increase + 1) AS threshold FROM joined j JOIN tops t ON t.year = j.year),
labels AS (SELECT *, CASE WHEN year <= 1999 THEN 'Past' WHEN NOT eligible THEN 'High Income and/or Housing'
    WHEN NOT risen THEN 'Low Increase Rate' ELSE 'N/A' END AS reason,
  CASE WHEN eligible AND risen THEN 'gent' WHEN price_start < house_low THEN 'no_low' WHEN price_start < house_high THEN 'no_mid' ELSE 'no_high' END AS class
  FROM flags)"""


def labels(spark, sf):
    return plans.label_areas(panel(spark, sf), span=4, last_actual_year=1999)


@query("I-6 E-10", f"""
WITH {PANEL_CTE}, {BANDS}
SELECT year, round(income_low, 6) AS income_low, round(income_high, 6) AS income_high, round(house_low, 5) AS house_low, round(house_high, 5) AS house_high FROM bands""")
def year_bands(spark, sf):
    return plans.year_bands(panel(spark, sf)).withColumns(rounded(6, "income_low", "income_high") | rounded(5, "house_low", "house_high"))


@query("I-1", f"""
WITH {LABELS}
SELECT area, year, eligible, risen, round(increase, 8) AS increase, round(top_increase, 8) AS top_increase, round(threshold, 4) AS threshold FROM labels""")
def label_areas(spark, sf):
    out = labels(spark, sf).select("area", "year", "eligible", "risen", "increase", "top_increase", "threshold")
    return out.withColumns(rounded(8, "increase", "top_increase") | rounded(4, "threshold"))


@query("I-2 B-34", f"""
WITH {LABELS}
SELECT area, year, reason, CASE reason WHEN 'Past' THEN 'Prediction only applicable for years after 2015'
  WHEN 'High Income and/or Housing' THEN 'Not eligible: above average house value and/or income'
  WHEN 'Low Increase Rate' THEN 'Not eligible: house value did not increase enough' END AS sentence FROM labels""")
def ineligibility_reason(spark, sf):
    from areapanel.functions.text import reason_sentence

    return labels(spark, sf).select("area", "year", "reason", reason_sentence(F.col("reason")).alias("sentence"))


@query("I-3 B-21", f"""
WITH {LABELS}
SELECT area, year, class, CASE class WHEN 'gent' THEN '#1565C0' WHEN 'no_low' THEN '#4CAF50' WHEN 'no_mid' THEN '#FBC02D' ELSE '#424242' END AS color,
  CASE class WHEN 'gent' THEN 'blue' WHEN 'no_low' THEN 'green' WHEN 'no_mid' THEN 'orange' ELSE 'lightgray' END AS icon_color FROM labels""")
def area_class(spark, sf):
    return plans.with_colors(labels(spark, sf)).select("area", "year", "class", "color", "icon_color")


PROBABILITY = LABELS + """, g AS (SELECT area, year, price, reason, price / 100000 * (price / 100000) / 0.05::DOUBLE AS a, price / 100000 / 0.05::DOUBLE * (threshold / 100000) AS z FROM labels),
cdf AS (SELECT area, year, least(1.0, sum(exp((a + k) * ln(z) - z - lgamma(a + k + 1)))) AS cdf FROM g CROSS JOIN (SELECT unnest(range(800)) AS k) t GROUP BY 1, 2),
prob AS (SELECT g.area, g.year, g.price, g.reason, CASE WHEN reason = 'N/A' THEN 1 - cdf ELSE 0.0 END AS probability FROM g JOIN cdf c ON c.area = g.area AND c.year = g.year)"""


def probabilities(spark, sf):
    from areapanel.functions.probability import gamma_params

    l = labels(spark, sf)
    a, b = gamma_params(F.col("price") / 100000, F.lit(0.05))
    scaled = l.withColumns({"alpha": a, "beta": b, "threshold": F.col("threshold") / 100000})
    return plans.area_probability(scaled)


@query("I-4", f"WITH {PROBABILITY} SELECT area, year, reason, round(probability, 7) AS probability FROM prob")
def area_probability(spark, sf):
    return probabilities(spark, sf).select("area", "year", "reason", F.round("probability", 7).alias("probability"))


@query("I-5 J-5", f"""
WITH {PROBABILITY}
SELECT area, row_number() OVER (ORDER BY round(probability, 6) DESC, area) AS rank, CAST(round_even(round(probability, 6) * 100, 0) AS INTEGER) AS percent,
  round_even(price / 100000, 4) AS index FROM prob WHERE year = 2001""")
def ranking_of_year(spark, sf):
    p = probabilities(spark, sf).withColumns({"probability": F.round("probability", 6), "price": F.col("price") / 100000})
    return plans.ranking(p, 2001).select("area", "rank", "percent", "index")


@query("I-6 J-5", f"""
WITH {PANEL_CTE}, {BANDS}
SELECT p.area, p.year, price, CASE WHEN p.year <= 1999 THEN income END AS income,
  CASE WHEN p.year <= 1999 THEN round(income_low, 6) END AS income_low, CASE WHEN p.year <= 1999 THEN round(income_high, 6) END AS income_high,
  round(house_low, 5) AS house_low, round(house_high, 5) AS house_high
FROM panel p LEFT JOIN bands b ON b.year = p.year WHERE area = 3 AND p.year <= 2000""")
def series_of_area(spark, sf):
    p = panel(spark, sf)
    out = plans.area_series(p, plans.year_bands(p), 3, 2000, 1999)
    return out.withColumns(rounded(6, "income_low", "income_high") | rounded(5, "house_low", "house_high"))


@query("F-7 I-6", f"""
WITH {PANEL_CTE}
SELECT area, year, price, round((price / first_value(price) OVER (ORDER BY year) - 1) * 100, 8) AS increase,
  first_value(year) OVER (ORDER BY year) AS frame_start FROM panel WHERE area = 3 AND year BETWEEN 1996 AND 2000""")
def increase_of_area(spark, sf):
    out = plans.increase_series(panel(spark, sf), 3, 2000, 4)
    return out.withColumns(rounded(8, "increase"))


POINTS = """points AS (SELECT l_suppkey AS area, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS x, l_discount AS y, count(*) AS crime_count
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def _points(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("area"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("x"),
                      F.col("l_discount").alias("y")).agg(F.count(F.lit(1)).alias("crime_count"))


@query("I-7 E-5 B-20", f"""
WITH {POINTS}, box AS (SELECT area, max(y) AS max_y, max(x) AS max_x, min(y) AS min_y, min(x) AS min_x FROM points GROUP BY 1)
SELECT p.area, p.year, x, y, crime_count, crime_count / 10.0::DOUBLE AS size, CASE WHEN crime_count >= 10 THEN 'red' ELSE 'grey' END AS flag,
  CAST(sum(crime_count) OVER () AS BIGINT) AS total, max_y, max_x, min_y, min_x
FROM points p LEFT JOIN box b ON b.area = p.area WHERE p.area = 5 AND p.year = 1998""")
def crime_map_slice(spark, sf):
    points = _points(spark, sf)
    return plans.crime_slice(points, plans_extents(points), 5, 1998)


def plans_extents(points):
    from areapanel.plans.crimes import extents

    return extents(points, "x", "y")


@query("I-8 B-18 B-19", f"""
WITH {POINTS}
SELECT area, year, x, y, crime_count AS num_permits, least(crime_count, 10) AS intensity, 11 - least(crime_count, 10) AS reverse FROM points WHERE area = 9 AND year = 2000""")
def permit_heat_slice(spark, sf):
    return plans.permit_slice(_points(spark, sf).withColumnRenamed("crime_count", "num_permits"), 9, 2000)


@query("E-7 B-34", """
WITH t AS (SELECT s_nationkey AS area, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS a1,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS a2, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS nb
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT area, year, 'Count by permit type: A1 = ' || a1::VARCHAR || ', A2 = ' || a2::VARCHAR || ', NB = ' || nb::VARCHAR || ', DM = 0' AS sentence FROM t""")
def permit_totals(spark, sf):
    from areapanel.functions.text import permit_sentence

    li = table(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("job_type")).agg(
        F.count(F.lit(1)).alias("num_permits"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    t = plans.permit_totals(li.join(s, "l_suppkey"), ["A", "N", "R", "D"])
    return t.select("area", "year", permit_sentence(F.col("A"), F.col("N"), F.col("R"), F.col("D")).alias("sentence"))


@query("J-5 G-3", f"WITH {PANEL_CTE} SELECT area FROM panel WHERE year = 2000 ORDER BY price DESC, area LIMIT 1")
def default_area(spark, sf):
    return plans.top_area(panel(spark, sf), 2000, "price")
