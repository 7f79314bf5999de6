"""Whole pipelines: permits, events, shops, prices, features, forecasts and the flagship ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.aggregates import MONTHLY, monthly
from areapanel.catalog.base import (
    AREAS_CTE, PANEL_CTE, WIDE_CTE, YEARS, areas, panel, query, rounded, table, wide_counts,
)
from areapanel.operators.panel import deflator, growth_overall, rank_areas
from areapanel.operators.reshape import top_k
from areapanel.operators.scale import lookup_join, materialize, scratch_path
from areapanel.plans import crimes, features, forecast, permits, prices, shops
from areapanel.sources.sinks import write_table
from areapanel.sources.tables import read_named_table

# --- flagship -----------------------------------------------------------------------------------------------------


@query("D-7 F-4 F-15 G-3 D-9 E-1", f"""
WITH {PANEL_CTE}, {AREAS_CTE},
counts AS (SELECT c_nationkey AS area, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
grid AS (SELECT a.area, y.year, coalesce(c.n, 0) AS n FROM areas a CROSS JOIN (SELECT unnest([1995, 1996, 1997, 1998, 1999, 2000, 2001]) AS year) y
  LEFT JOIN counts c ON c.area = a.area AND c.year = y.year),
gr AS (SELECT area, (1 - arg_min(n, year) / nullif(arg_max(n, year), 0)::DOUBLE) / (max(year) - min(year)) AS growth FROM grid GROUP BY 1),
ed AS (SELECT area, CAST(trim(unnest(string_split(adjacent, ','))) AS INTEGER) AS nbr FROM areas),
nb AS (SELECT e.area, round_even(avg(n), 2) AS adjacent_n FROM ed e JOIN grid g ON g.area = e.nbr AND g.year = 2001 GROUP BY 1)
SELECT a.area, name, round(growth, 10) AS growth, g.n, adjacent_n, row_number() OVER (ORDER BY round(growth, 10) DESC, a.area) AS rank
FROM areas a JOIN gr ON gr.area = a.area JOIN grid g ON g.area = a.area AND g.year = 2001 LEFT JOIN nb ON nb.area = a.area
WHERE growth IS NOT NULL ORDER BY rank LIMIT 10""")
def growth_ranking(spark, sf):
    """The ten areas whose order counts grew fastest over all years, next to their neighbours' average."""
    from areapanel.operators.joins import complete_grid, neighbor_avg

    known = areas(spark, sf)
    counts = panel(spark, sf).select("area", "year", F.col("n").alias("count"))
    grid = materialize(complete_grid(counts, known, {"year": YEARS}).withColumnRenamed("count", "n"))
    growth = growth_overall(grid, "n", "growth").withColumns(rounded(10, "growth"))
    near = neighbor_avg(grid, known, {"n": "adjacent_n"}).filter("year = 2001")
    rows = known.select("area", "name").join(growth, "area").join(near.drop("year"), "area").withColumn("year", F.lit(2001))
    ranked = rank_areas(rows, "growth").select("area", "name", "growth", "n", "adjacent_n", "rank")
    return top_k(ranked, [F.col("rank")], 10)


# --- permits ------------------------------------------------------------------------------------------------------


def filings(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("doc"), F.col("l_returnflag").alias("job_type"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("filing_date"), "l_suppkey")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    return lookup_join(li, s, ["l_suppkey"], "inner", derived=False).drop("l_suppkey")


PERMITS = """jobs AS (SELECT l_orderkey AS job, l_returnflag AS job_type, s_nationkey AS area, CAST(min(year(l_shipdate)) AS INTEGER) AS year
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  WHERE l_linenumber = 1 AND l_returnflag IN ('A', 'R') AND s_nationkey < 20 GROUP BY 1, 2, 3),
permits AS (SELECT a.area, y.year, t.job_type, count(j.job) AS count
  FROM (SELECT n_nationkey AS area FROM nation WHERE n_nationkey < 20) a CROSS JOIN (SELECT DISTINCT year FROM jobs) y
  CROSS JOIN (SELECT unnest(['A', 'R']) AS job_type) t
  LEFT JOIN jobs j ON j.area = a.area AND j.year = y.year AND j.job_type = t.job_type GROUP BY 1, 2, 3)"""


def _permits(spark, sf):
    return permits.permit_counts(filings(spark, sf), areas(spark, sf).filter("area < 20"), types=("A", "R"))


@query("C-10 C-7 B-14 E-3 E-1 D-9", f"WITH {PERMITS} SELECT area, year, job_type, count FROM permits")
def permit_counts(spark, sf):
    return _permits(spark, sf)


@query("E-14 D-1 D-2", f"""
WITH {PANEL_CTE}, {PERMITS},
w AS (SELECT area, year, CAST(sum(CASE WHEN job_type = 'A' THEN count END) AS BIGINT) AS A, CAST(sum(CASE WHEN job_type = 'R' THEN count END) AS BIGINT) AS R FROM permits GROUP BY 1, 2)
SELECT p.area, p.year, p.n, A, R FROM panel p LEFT JOIN w ON w.area = p.area AND w.year = p.year""")
def panel_with_permits(spark, sf):
    return permits.add_permit_columns(panel(spark, sf).select("area", "year", "n"), _permits(spark, sf), ("A", "R"))


@query("E-1 E-2", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS job_type, s_nationkey AS area, l_quantity AS lat, l_discount AS lon, count(*) AS num_permits
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4, 5""")
def permit_points(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("job_type"), F.col("l_quantity").alias("lat"),
        F.col("l_discount").alias("lon"), "l_suppkey")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    return permits.permit_points(lookup_join(li, s, ["l_suppkey"], "inner", derived=False), "lat", "lon")


# --- events -------------------------------------------------------------------------------------------------------

EVENTS = """placed AS (SELECT l_quantity + 0.12344::DOUBLE AS lat, l_discount + 0.56786::DOUBLE AS lon, CASE WHEN l_orderkey % 29 = 0 THEN '1015-02-04' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') AND l_tax <> 0),
keyed AS (SELECT round(lat, 4) AS lat_key, round(lon, 4) AS lon_key, CAST(substr(day, 1, 4) AS INTEGER) AS year FROM placed),
events_in AS (SELECT *, CAST(floor(lat_key) AS INTEGER) % 25 AS area FROM keyed WHERE year >= 1996 AND floor(lat_key) < 45)"""


def _events(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("code"), F.when(F.col("l_tax") != 0, F.col("l_quantity") + 0.12344).alias("lat"),
        (F.col("l_discount") + 0.56786).alias("lon"),
        F.when(F.col("l_orderkey") % 29 == 0, "1015-02-04").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"))
    codes = table(spark, sf, "part").filter("p_type = 'SMALL'").select(F.col("p_partkey").alias("code"))
    found = crimes.violent_events(li, codes)

    def resolve(keys):
        whole = F.floor(F.col("lat_key").cast("double")).cast("int")
        return keys.filter(whole < 45).withColumn("area", whole % 25)

    return crimes.with_year(crimes.with_area(found, resolve), "day", 1996)


@query("A-10 B-9 B-13 C-5 C-6 D-6 I-10", f"WITH {EVENTS} SELECT area, year, count(*) AS crime_count FROM events_in GROUP BY 1, 2")
def crime_yearly(spark, sf):
    return crimes.crime_yearly(_events(spark, sf))


@query("E-1 A-12", f"WITH {EVENTS} SELECT year, lat_key AS lat, lon_key AS lon, area, count(*) AS crime_count FROM events_in GROUP BY 1, 2, 3, 4")
def crime_points(spark, sf):
    points = crimes.crime_points(_events(spark, sf))
    return points.select("year", F.col("lat_key").cast("double").alias("lat"), F.col("lon_key").cast("double").alias("lon"), "area", "crime_count")


# --- shops --------------------------------------------------------------------------------------------------------

SHOPS = """dated AS (SELECT o_custkey AS shop, o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN DATE '1900-01-01' ELSE CAST(o_orderdate AS DATE) END AS day,
    o_orderpriority AS cuisine, o_orderstatus AS inspection FROM orders),
dd AS (SELECT *, row_number() OVER (PARTITION BY shop, day ORDER BY o_orderkey) AS r, FROM dated WHERE day <> DATE '1900-01-01'),
fi AS (SELECT *, rank() OVER (PARTITION BY shop ORDER BY day) AS k FROM dd WHERE r = 1),
firsts AS (SELECT c_nationkey AS area, cuisine, inspection, CAST(year(day) AS INTEGER) AS year FROM fi JOIN customer ON c_custkey = shop WHERE k = 1)"""


def _firsts(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("shop"), "o_orderkey",
        F.when(F.col("o_orderkey") % 23 == 0, "1900-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.col("o_orderpriority").alias("cuisine"), F.col("o_orderstatus").alias("inspection"))
    first = shops.first_inspections(o, [F.col("o_orderkey")])
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("shop"), F.col("c_nationkey").alias("area"), F.col("c_name").alias("name"))
    return first.join(c, "shop")


def _shop_sql(op: str, extra: str = "") -> str:
    cols = ", ".join(f'CAST(sum(CASE WHEN year {op} {y} THEN 1 ELSE 0 END) AS BIGINT) AS "{y}"' for y in YEARS)
    if op == "<=":
        cols = cols.replace("year <=", f"year IN {YEARS} AND year <=")
    return f"WITH {SHOPS} SELECT area, {cols} FROM firsts WHERE cuisine = '2-HIGH' {extra} GROUP BY 1"


@query("I-9 F-11 E-4 E-25 F-6 C-4", _shop_sql("<="))
def shops_cumulative(spark, sf):
    return shops.shop_counts(_firsts(spark, sf), YEARS, cuisine="2-HIGH")


@query("I-9 E-25", _shop_sql("=", "AND inspection = 'O'"))
def shops_opened(spark, sf):
    return shops.shop_counts(_firsts(spark, sf), YEARS, cuisine="2-HIGH", opening="O", cumulative=False)


@query("I-9 F-6", f"""
WITH {SHOPS}, y AS (SELECT area, year, count(*) AS opened FROM firsts WHERE cuisine = '2-HIGH' GROUP BY 1, 2)
SELECT area, year, opened, CAST(sum(opened) OVER (PARTITION BY area ORDER BY year) AS BIGINT) AS total FROM y""")
def shops_by_year(spark, sf):
    return shops.shop_counts_long(_firsts(spark, sf), cuisine="2-HIGH")


# --- prices -------------------------------------------------------------------------------------------------------

MONTHS = [f"{y}-{m:02d}" for y in YEARS for m in range(1, 13)]


def _wide_prices(spark, sf):
    m = monthly(spark, sf).filter(F.col("month").isin(MONTHS))
    wide = m.groupBy(F.col("dataset").alias("Dataset"), F.col("area").alias("RegionName")).pivot("month", MONTHS).agg(F.first("value"))
    # The sheet as a file: its header tells which columns are months.
    path = scratch_path(spark)
    write_table(wide, path, "csv")
    return read_named_table(spark, path, {"Dataset": "string", "RegionName": "int"} | {month: "double" for month in MONTHS})


def _price_sql(divisor: str) -> str:
    return f"""
WITH {MONTHLY}, m AS (SELECT * FROM monthly WHERE dataset <> '5-LOW' AND month IN ({", ".join(f"'{x}'" for x in MONTHS)})),
s AS (SELECT m.area, m.month, m.value / {divisor} AS v FROM m),
mm AS (SELECT area, month, avg(v) AS v FROM s GROUP BY 1, 2),
yy AS (SELECT area, CAST(substr(month, 1, 4) AS INTEGER) AS year, round(avg(v), 8) AS v FROM mm GROUP BY 1, 2)
SELECT a.area, y.year, yy.v AS "index" FROM (SELECT DISTINCT area FROM m) a CROSS JOIN (SELECT unnest([{", ".join(map(str, YEARS))}]) AS year) y
LEFT JOIN yy ON yy.area = a.area AND yy.year = y.year"""


@query("A-5 C-4 E-15 E-16 E-9 E-8", _price_sql("(SELECT max(x.value) FROM m x WHERE x.month = '1998-08' AND x.dataset = m.dataset)"))
def price_index_by_group_max(spark, sf):
    long = prices.long_prices(_wide_prices(spark, sf), ["Dataset", "RegionName"], "5-LOW")
    return prices.price_index(long, "group", "1998-08").withColumns(rounded(8, "index"))


@query("A-5 C-4 E-15 E-17 E-9 E-8", _price_sql("(SELECT max(x.value) FROM m x WHERE x.month = '1998-08' AND x.dataset = m.dataset AND x.area = m.area)"))
def price_index_by_own_base(spark, sf):
    long = prices.long_prices(_wide_prices(spark, sf), ["Dataset", "RegionName"], "5-LOW")
    return prices.price_index(long, "own", "1998-08").withColumns(rounded(8, "index"))


# --- features -----------------------------------------------------------------------------------------------------

FEATURES = f"""{PANEL_CTE}, {AREAS_CTE},
rates AS (SELECT year, (year - 1990) / 500.0::DOUBLE AS rate FROM (SELECT DISTINCT year FROM panel)),
f AS (SELECT year, coalesce(product(1 + rate) OVER (ORDER BY year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS factor FROM rates),
pts AS (SELECT n_nationkey AS area, (n_nationkey * 7 % 25) / 10.0::DOUBLE AS x, (n_nationkey * 11 % 25) / 10.0::DOUBLE AS y FROM nation),
adj AS (SELECT p.area, p.year, x, y, income * factor AS income_adj, price * factor AS price_adj FROM panel p JOIN f ON f.year = p.year JOIN pts ON pts.area = p.area),
ed AS (SELECT area, CAST(trim(unnest(string_split(adjacent, ','))) AS INTEGER) AS nbr FROM areas),
nb AS (SELECT p.area, p.year, round(avg(q.income_adj), 2) AS adjacent_income, round(avg(q.price_adj), 2) AS adjacent_price
  FROM adj p JOIN ed e ON e.area = p.area JOIN adj q ON q.area = e.nbr AND q.year = p.year GROUP BY 1, 2),
cut AS (SELECT year, quantile_cont(income_adj, 0.9) AS q FROM adj GROUP BY 1),
near AS (SELECT p.area, p.year, round(min(sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y))), 10) AS proximity
  FROM adj p JOIN adj t ON t.year = p.year JOIN cut c ON c.year = t.year WHERE t.income_adj >= c.q GROUP BY 1, 2)"""


@query("F-9 F-10 D-7 D-8 E-10 C-11", f"""
WITH {FEATURES}
SELECT a.area, a.year, round(income_adj, 4) AS income_adj, round(price_adj, 3) AS price_adj, adjacent_income, adjacent_price, proximity
FROM adj a JOIN nb ON nb.area = a.area AND nb.year = a.year JOIN near ON near.area = a.area AND near.year = a.year""")
def area_features(spark, sf):
    p = panel(spark, sf)
    rates = p.select("year").distinct().select("year", ((F.col("year") - 1990) / 500).alias("rate"))
    a = areas(spark, sf)
    place = a.select("area", ((F.col("area") * 7 % 25) / 10).alias("x"), ((F.col("area") * 11 % 25) / 10).alias("y"))
    out = features.add_features(p.join(place, "area"), a, deflator(rates))
    return out.select("area", "year", "income_adj", "price_adj", "adjacent_income", "adjacent_price", "proximity").withColumns(
        rounded(4, "income_adj") | rounded(3, "price_adj") | rounded(2, "adjacent_income", "adjacent_price") | rounded(10, "proximity"))


# --- model frames and forecasts -----------------------------------------------------------------------------------


def _model_panel(spark, sf):
    """Panel with all columns a model frame needs."""
    p = panel(spark, sf).withColumns({"price": F.col("price") / 100000, "income": F.col("income")})
    w = wide_counts(spark, sf)
    a = areas(spark, sf).select("area", "borough", F.col("name").alias("neighborhood"))
    return p.join(w, ["area", "year"]).join(a, "area").withColumns({
        "crime_count": F.col("n"), "lines": F.when(F.col("area") % 4 != 0, F.col("area") % 6),
        "water": F.when(F.col("area") % 2 == 0, "Y").otherwise("N"), "proximity": (F.col("area") * 7 % 25) / 10})


W = "OVER (PARTITION BY area ORDER BY year)"
MODEL_PANEL = WIDE_CTE + ", " + PANEL_CTE + f""", mp AS (
  SELECT p.area, p.year, p.price / 100000 AS price, p.income, p.n AS crime_count, w.A1, w.A2, w.DM, w.NB, w.land, n_regionkey AS borough, n_name AS neighborhood,
    CASE WHEN p.area % 4 <> 0 THEN p.area % 6 END AS lines, CASE WHEN p.area % 2 = 0 THEN 'Y' ELSE 'N' END AS water, (p.area * 7 % 25) / 10.0::DOUBLE AS proximity
  FROM panel p JOIN wide w ON w.area = p.area AND w.year = p.year JOIN nation ON n_nationkey = p.area),
lags AS (SELECT *, ln(crime_count / land) AS log_crime, ln(lag(crime_count / land) {W}) AS log_prev_crime,
  CASE WHEN income > 0 THEN ln(income) END AS log_income, lag(price) {W} AS prev_price,
  ln(lag(NB) {W} + 1.001) AS nb_lag1, ln(lag(A1) {W} + 1.001) AS a1_lag1, ln(lag(A2) {W} + 1.001) AS a2_lag1,
  ln(lag(DM / land) {W} + 1.001) AS dm_lag1, ln(lag(DM / land, 2) {W} + 1.001) AS dm_lag2,
  CASE WHEN coalesce(lines, 0) <= 0 THEN '0' WHEN lines <= 2 THEN '1-2' ELSE '3+' END AS line_class FROM mp),
lags2 AS (SELECT *, lag(log_income) {W} AS log_prev_income FROM lags),
training AS (SELECT area, year, price, prev_price, borough, water, neighborhood, proximity, line_class, nb_lag1, a1_lag1, a2_lag1, dm_lag2, log_prev_crime
  FROM lags2 WHERE log_crime IS NOT NULL AND log_prev_crime IS NOT NULL AND log_income IS NOT NULL AND log_prev_income IS NOT NULL AND prev_price IS NOT NULL AND dm_lag1 IS NOT NULL AND dm_lag2 IS NOT NULL)"""
FRAME_COLS = """area, year, price, prev_price, borough, water, neighborhood, round(proximity, 8) AS proximity, line_class,
  round(nb_lag1, 8) AS nb_lag1, round(a1_lag1, 8) AS a1_lag1, round(a2_lag1, 8) AS a2_lag1, round(dm_lag2, 8) AS dm_lag2, round(log_prev_crime, 8) AS log_prev_crime, 1 AS intercept"""
FRAME_ROUNDED = ("proximity", "nb_lag1", "a1_lag1", "a2_lag1", "dm_lag2", "log_prev_crime")


@query("F-1 B-24 B-25 B-26 B-17 C-8 B-33 G-1", f"WITH {MODEL_PANEL} SELECT {FRAME_COLS} FROM training")
def training_frame(spark, sf):
    return forecast.training_frame(_model_panel(spark, sf)).withColumns(rounded(8, *FRAME_ROUNDED))


@query("H-17 D-4 G-4", f"""
WITH {MODEL_PANEL},
recent AS (SELECT l.area, l.year, l.price, l.prev_price, l.borough, l.water, l.neighborhood, l.proximity, l.line_class, l.nb_lag1, l.a1_lag1, l.a2_lag1, l.dm_lag2, c.log_crime AS log_prev_crime
  FROM lags l JOIN lags c ON c.area = l.area AND c.year = l.year - 1 WHERE l.year IN (2000, 2001))
SELECT {FRAME_COLS} FROM (SELECT * FROM recent UNION ALL SELECT * FROM training WHERE year < 2000)""")
def model_frame(spark, sf):
    from areapanel.functions.numeric import per_unit, safe_log

    p = _model_panel(spark, sf)
    crime = p.select("area", "year", safe_log(per_unit(F.col("crime_count"), F.col("land"))).alias("log_prev_crime"))
    logs = forecast.with_logs(p)
    static = logs.select("area", "borough", "water", "neighborhood", "proximity", "line_class").distinct()
    recent = forecast.recent_frame(p.select("area", "year", "price"), crime, p, static, [2000, 2001])
    training = forecast.training_frame(p).filter("year < 2000")
    return forecast.model_frame(training, recent).withColumns(rounded(8, *FRAME_ROUNDED))


CRIME_FORECAST = PANEL_CTE + f""",
g AS (SELECT area, year, n::DOUBLE AS v, 1 - lag(n) {W} / n::DOUBLE AS g FROM panel WHERE year IN (1999, 2000)),
o AS (SELECT area, (1 - arg_min(n, year) / arg_max(n, year)::DOUBLE) / (max(year) - min(year)) AS o FROM panel GROUP BY 1 HAVING max(year) > min(year)),
path AS (SELECT g.area, CAST(g.year + 1 AS INTEGER) AS year, round_even(g * v + v, 0) AS r, round_even(o * v + v, 0) AS a, g, o, 1 AS i
    FROM g JOIN o ON o.area = g.area WHERE g.year = 2000 AND g IS NOT NULL
  UNION ALL SELECT area, year + 1, round_even(g * r + r, 0), round_even(o * a + a, 0), g, o, i + 1 FROM path WHERE i < 9)"""


@query("F-3 F-4 F-14 H-16", f"""
WITH RECURSIVE {CRIME_FORECAST} SELECT area, year, r AS count_recent, a AS count_overall FROM path WHERE year >= 2002""")
def crime_forecast(spark, sf):
    crime = panel(spark, sf).select("area", "year", F.col("n").alias("crime_count"))
    return forecast.crime_forecast(crime, 2000, 8)


@query("F-14 H-16", f"""
WITH RECURSIVE {CRIME_FORECAST}
SELECT area, year, CASE WHEN r > 0 THEN round(ln(r / (1 + area / 10.0::DOUBLE)), 8) END AS log_recent, CASE WHEN a > 0 THEN round(ln(a / (1 + area / 10.0::DOUBLE)), 8) END AS log_overall
FROM path WHERE year >= 2002""")
def crime_density_forecast(spark, sf):
    crime = panel(spark, sf).select("area", "year", F.col("n").alias("crime_count"))
    ahead = forecast.crime_densities(forecast.crime_forecast(crime, 2000, 8), areas(spark, sf).select("area", "land"))
    return ahead.select("area", "year", F.round("log_recent", 8).alias("log_recent"), F.round("log_overall", 8).alias("log_overall"))


@query("H-14 H-16 D-10", f"""
WITH RECURSIVE {CRIME_FORECAST},
static AS (SELECT n_nationkey AS area, n_regionkey AS borough FROM nation),
pw AS (SELECT area, year, n AS A1, lag(n) {W} AS prev FROM panel)
SELECT s.area, p.year, s.borough, round(ln(q.n + 1.001), 8) AS a1_lag1, p.a AS count_overall
FROM static s JOIN path p ON p.area = s.area JOIN panel q ON q.area = s.area AND q.year = p.year - 6 WHERE p.year BETWEEN 2002 AND 2006""")
def forecast_frame(spark, sf):
    crime = panel(spark, sf).select("area", "year", F.col("n").alias("crime_count"))
    static = areas(spark, sf).select("area", "borough")
    # Permit lags of the forecast years, taken from six years before.
    lags = crime.select("area", (F.col("year") + 6).cast("int").alias("year"), F.round(F.ln(F.col("crime_count") + 1.001), 8).alias("a1_lag1"))
    ahead = forecast.crime_forecast(crime, 2000, 8).select("area", "year", "count_overall")
    return forecast.forecast_frame(static, range(2002, 2007), lags, ahead)


@query("F-13 H-7 H-8", f"""
WITH {MODEL_PANEL},
s AS (SELECT area, year, exp(nb_lag1 * (0.01::DOUBLE * borough) + a1_lag1 * 0.02::DOUBLE + (-2.0::DOUBLE - borough / 10.0::DOUBLE) + log_prev_crime * (0.01::DOUBLE * (area % 5))) AS inc FROM lags WHERE year >= 1997 AND nb_lag1 IS NOT NULL),
b AS (SELECT area, price AS base FROM mp WHERE year = 1996)
SELECT s.area, s.year, round(base + sum(inc) OVER (PARTITION BY s.area ORDER BY s.year), 8) AS mu FROM s JOIN b ON b.area = s.area""")
def rolled_scores(spark, sf):
    p = _model_panel(spark, sf)
    w_frame = permits.permit_lags(forecast.with_logs(p))
    from areapanel.operators.panel import by_area

    frame = w_frame.withColumns({"log_prev_crime": F.lag("log_crime").over(by_area()), "neighborhood": F.col("area") % 5})
    base = p.filter("year = 1996").select("area", F.col("price").alias("base_price"))
    frame = frame.filter("year >= 1997 AND nb_lag1 IS NOT NULL").join(base, "area")
    b = F.col("borough")
    boroughs = areas(spark, sf).select("borough").distinct().select("borough", F.array(b * 0.01, F.lit(0.02)).alias("betas"), (F.lit(-2.0) - b / 10).alias("gamma"))
    hoods = areas(spark, sf).select((F.col("area") % 5).alias("neighborhood")).distinct().withColumn("tau", F.col("neighborhood") * 0.01)
    out = forecast.roll_scores(frame, boroughs, hoods, ["nb_lag1", "a1_lag1"], "log_prev_crime", 0.5)
    return out.select("area", "year", F.round("mu", 8).alias("mu"))


@query("H-14", f"""
WITH {WIDE_CTE}, f AS (SELECT area, year, unnest(['A1', 'A2', 'DM', 'NB']) AS t, unnest([A1, A2, DM, NB])::DOUBLE AS v FROM wide WHERE year >= 1997),
r AS (SELECT area, t, sum(CASE WHEN year = 2001 THEN round_even(v * (1 + 1 / 12.0::DOUBLE), 0) ELSE v END) / 8 AS rate FROM f GROUP BY 1, 2),
y AS (SELECT area, t, rate, unnest(range(2002, 2010)) AS year FROM r),
u AS (SELECT *, CAST('0x' || substr(md5('3:' || area::VARCHAR || ':' || year::VARCHAR || ':' || t), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM y),
c AS (SELECT area, year, t, u, rate, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) END) OVER (PARTITION BY area, year, t ORDER BY k) AS cdf
  FROM (SELECT *, unnest(range(CAST(greatest(floor(rate - 12 * sqrt(rate) - 60), 0) AS BIGINT), CAST(ceil(rate + 12 * sqrt(rate) + 60) AS BIGINT) + 1)) AS k FROM u))
SELECT area, CAST(year AS INTEGER) AS year, {", ".join(f"CAST(max(drawn) FILTER (WHERE t = '{t}') AS BIGINT) AS {t}" for t in ("A1", "A2", "DM", "NB"))}
FROM (SELECT area, year, t, CASE WHEN max(rate) > 0 THEN min(k) + count(*) FILTER (WHERE cdf < u) ELSE 0 END AS drawn FROM c GROUP BY 1, 2, 3) s GROUP BY 1, 2""")
def permit_forecast(spark, sf):
    rates = permits.permit_rates(wide_counts(spark, sf), 2001, 1997)
    return forecast.permit_forecast(rates, range(2002, 2010), seed=3)




# The forecast from the panel to the ranking: stand-in parameters for 10 draws, 5 boroughs and 5 neighbourhoods.
DRAWS, SPAN, AHEAD = 10, 4, range(2002, 2010)


def forecast_parameters(spark, sf):
    """(by_borough, by_neighborhood, by_draw)"""
    b, d, n = F.col("borough").cast("double"), F.col("draw"), F.col("neighborhood")
    each = lambda df: df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    boroughs = each(areas(spark, sf).select("borough").distinct()).select(
        "draw", "borough", F.array(b * 0.01 + d * 0.002, F.lit(0.02), d * 0.003, F.lit(-0.01), F.lit(0.05)).alias("betas"), (F.lit(-3.0) - b / 10 - d * 0.01).alias("gamma"))
    hoods = each(areas(spark, sf).select((F.col("area") % 5).alias("neighborhood")).distinct()).select("draw", "neighborhood", (n * 0.01 - d * 0.001).alias("tau"))
    return boroughs, hoods, spark.range(DRAWS).select(F.col("id").cast("int").alias("draw"), (F.col("id") * 0.005 + 0.05).alias("phi"))


@query("H-16 H-14 H-7 F-13 H-8 H-10 I-1 I-4 I-5 F-14", f"""
WITH RECURSIVE {CRIME_FORECAST}, {WIDE_CTE}, {AREAS_CTE},
crime AS (SELECT path.area, path.year, ln(a / land) AS log_overall FROM path JOIN areas ON areas.area = path.area WHERE path.year BETWEEN 2002 AND 2009 AND a > 0
  QUALIFY count(*) OVER (PARTITION BY path.area) = 8),
f AS (SELECT area, year, unnest(['A1', 'A2', 'DM', 'NB']) AS t, unnest([A1, A2, DM, NB])::DOUBLE AS v FROM wide),
full_years AS (SELECT area, year, t, CASE WHEN year = 2001 THEN round_even(v * (1 + 1 / 12.0::DOUBLE), 0) ELSE v END AS v FROM f),
rates AS (SELECT area, t, sum(v) / 8 AS rate FROM full_years WHERE year >= 1997 GROUP BY 1, 2),
u AS (SELECT area, t, rate, draw, year, CAST('0x' || substr(md5('3:' || area::VARCHAR || ':' || draw::VARCHAR || ':' || year::VARCHAR || ':' || t), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT area, t, rate, unnest(range({DRAWS})) AS draw FROM rates) CROSS JOIN (SELECT unnest(range(2002, 2010)) AS year) y),
c AS (SELECT area, t, rate, draw, year, u, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) END) OVER (PARTITION BY area, t, draw, year ORDER BY k) AS cdf
  FROM (SELECT *, unnest(range(CAST(greatest(floor(rate - 12 * sqrt(rate) - 60), 0) AS BIGINT), CAST(ceil(rate + 12 * sqrt(rate) + 60) AS BIGINT) + 1)) AS k FROM u)),
drawn AS (SELECT area, t, draw, year, CASE WHEN max(rate) > 0 THEN min(k) + count(*) FILTER (WHERE cdf < u) ELSE 0 END::DOUBLE AS v FROM c GROUP BY 1, 2, 3, 4),
known AS (SELECT area, t, draw, year, v FROM full_years CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw) d WHERE year >= 2000 UNION ALL SELECT area, t, draw, year, v FROM drawn),
perm AS (SELECT k.area, draw, k.year, max(v) FILTER (WHERE t = 'NB') AS nb, max(v) FILTER (WHERE t = 'A1') AS a1, max(v) FILTER (WHERE t = 'A2') AS a2, max(v / land) FILTER (WHERE t = 'DM') AS dm
  FROM known k JOIN areas ON areas.area = k.area GROUP BY 1, 2, 3),
lagged AS (SELECT *, ln(lag(nb) OVER p + 1.001) AS nb1, ln(lag(a1) OVER p + 1.001) AS a11, ln(lag(a2) OVER p + 1.001) AS a21, ln(lag(dm, 2) OVER p + 1.001) AS dm2
  FROM perm WINDOW p AS (PARTITION BY area, draw ORDER BY year)),
inc AS (SELECT l.area, l.draw, l.year, exp(nb1 * (borough * 0.01::DOUBLE + draw * 0.002::DOUBLE) + a11 * 0.02::DOUBLE + a21 * (draw * 0.003::DOUBLE) + dm2 * -0.01::DOUBLE + (l.area * 7 % 25) / 10.0::DOUBLE * 0.05::DOUBLE
    + (-3.0::DOUBLE - borough / 10.0::DOUBLE - draw * 0.01::DOUBLE) + log_overall * ((l.area % 5) * 0.01::DOUBLE - draw * 0.001::DOUBLE)) AS inc
  FROM lagged l JOIN areas ON areas.area = l.area JOIN crime ON crime.area = l.area AND crime.year = l.year WHERE l.year >= 2002),
mus AS (SELECT i.area, draw, i.year, p.price / 100000 + sum(inc) OVER (PARTITION BY i.area, draw ORDER BY i.year) AS mu, draw * 0.005::DOUBLE + 0.05::DOUBLE AS phi
  FROM inc i JOIN panel p ON p.area = i.area AND p.year = 2001),
fc AS (SELECT area, year, avg(mu) AS price, avg(mu * mu / phi) AS alpha, avg(mu / phi) AS beta FROM mus GROUP BY 1, 2),
both_ AS (SELECT area, year, income, price / 100000 AS price FROM panel UNION ALL SELECT area, year, NULL, price FROM fc),
bands AS (SELECT year, quantile_cont(income, 0.4) AS income_low, quantile_cont(price, 0.4) AS house_low FROM both_ GROUP BY 1),
joined AS (SELECT p.area, p.year, p.price, s.income AS income_start, s.price AS price_start, b.income_low, b.house_low, p.price / s.price - 1 AS increase
  FROM both_ p JOIN both_ s ON s.area = p.area AND s.year = p.year - {SPAN} JOIN bands b ON b.year = p.year - {SPAN}),
tops AS (SELECT year, quantile_cont(increase, 2 / 3.0::DOUBLE) AS top_increase FROM joined GROUP BY 1),
graded AS (SELECT j.area, j.year, j.price, alpha, beta, income_start < income_low AND price_start < house_low AND increase > top_increase AS wanted, beta * price_start * (top_increase + 1) AS z
  FROM joined j JOIN tops t ON t.year = j.year JOIN fc ON fc.area = j.area AND fc.year = j.year WHERE j.year IN (2004, 2005)),
cdf AS (SELECT area, year, least(1.0, sum(exp((alpha + k) * ln(z) - z - lgamma(alpha + k + 1)))) AS cdf FROM graded CROSS JOIN (SELECT unnest(range(2500)) AS k) t GROUP BY 1, 2),
prob AS (SELECT g.area, g.year, g.price, round(CASE WHEN wanted THEN 1 - cdf ELSE 0.0 END, 6) AS probability FROM graded g JOIN cdf c ON c.area = g.area AND c.year = g.year)
SELECT area, CAST(year AS INTEGER) AS year, row_number() OVER (PARTITION BY year ORDER BY probability DESC, area) AS rank, CAST(round_even(probability * 100, 0) AS INTEGER) AS percent, round(price, 6) AS price FROM prob""")
def panel_to_ranking(spark, sf):
    """Permits are drawn year by year for each draw of the parameters, and become the lags of the years after."""
    from areapanel.operators.reshape import concat
    from areapanel.plans.areas import ranking

    p = materialize(_model_panel(spark, sf).withColumn("neighborhood", F.col("area") % 5))
    crime = forecast.crime_densities(forecast.crime_forecast(p.select("area", "year", "crime_count"), 2000, 8), p.select("area", "land"))
    paths = forecast.forecast_paths(forecast.path_start(p, 2001, 1997), crime, *forecast_parameters(spark, sf), AHEAD, seed=3)
    scored = forecast.forecast_ranking(p, paths, SPAN, 2001).withColumn("probability", F.round("probability", 6))
    shown = concat([ranking(scored, year) for year in (2004, 2005)])
    return shown.select("area", "year", "rank", "percent", F.round("price", 6).alias("price"))
