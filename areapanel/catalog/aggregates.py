"""Grouped aggregates, distributions and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import (
    AREAS_CTE, CATEGORY_CTE, PANEL_CTE, PRIORITIES, areas, category_counts, panel, query, rounded, table,
)
from areapanel.operators import aggregates, distribution, reshape


@query("E-1 I-10", f"WITH {CATEGORY_CTE} SELECT area, year, category, count FROM counts")
def count_by_area_year_type(spark, sf):
    return category_counts(spark, sf)


@query("E-1", """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS category, o_orderstatus, count(*) AS count
FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2""")
def count_without_null_keys(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("category"), "o_orderstatus")
    return aggregates.count_by(o, ["category", "o_orderstatus"])


@query("E-2", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS count FROM lineitem GROUP BY 1")
def rows_per_year(spark, sf):
    return aggregates.count_by(table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")), ["year"])


@query("E-3", """
SELECT l_orderkey, l_returnflag, CAST(min(year(l_shipdate)) AS INTEGER) AS year FROM lineitem GROUP BY 1, 2""")
def first_year_per_job(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.year("l_shipdate").alias("y"))
    return aggregates.min_by_key(li, ["l_orderkey", "l_returnflag"], "y", "year")


@query("E-4", """
SELECT l_orderkey, l_suppkey, l_shipdate FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS r FROM lineitem) WHERE r = 1""")
def earliest_record(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    return aggregates.earliest(li, "l_suppkey", "l_shipdate")


@query("F-11", """
SELECT user_id, event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def dedupe_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return aggregates.dedupe_first(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query("E-5", """
SELECT label AS area, max(embedding[2]) AS max_y, max(embedding[1]) AS max_x, min(embedding[2]) AS min_y, min(embedding[1]) AS min_x
FROM embeddings GROUP BY 1""")
def bounding_box(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("area"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return aggregates.bbox(e, "area", "x", "y")


@query("E-5", """
SELECT l_suppkey AS area, max(l_extendedprice) AS max_y, max(l_quantity) AS max_x, min(l_extendedprice) AS min_y, min(l_quantity) AS min_x
FROM lineitem WHERE year(l_shipdate) IN (1996, 2000) GROUP BY 1""")
def bounding_box_two_years(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("area"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        F.year("l_shipdate").alias("year"))
    return aggregates.bbox(li, "area", "x", "y", [1996, 2000])


@query("E-6", """
SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS price, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS quantity
FROM lineitem GROUP BY 1""")
def sums_by_key(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"))
    out = aggregates.sum_by(li, ["l_suppkey"], ["price", "quantity"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("price", "quantity")})


@query("E-7", f"""
WITH {CATEGORY_CTE}
SELECT area, year, {", ".join(f"CAST(sum(CASE WHEN category = '{p}' THEN count ELSE 0 END) AS BIGINT) AS p{p[0]}" for p in PRIORITIES)}
FROM counts GROUP BY 1, 2""")
def sums_by_category(spark, sf):
    out = aggregates.sums_by_category(category_counts(spark, sf), ["area", "year"], "category", "count", PRIORITIES)
    return out.withColumnsRenamed({p: f"p{p[0]}" for p in PRIORITIES})


MONTHLY = """monthly AS (SELECT o_orderpriority AS dataset, c_nationkey AS area, strftime(o_orderdate, '%Y-%m') AS month,
  floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def monthly(spark, sf):
    """(dataset, area, month, value): mean order value per priority, area and month, in whole units.

    Sums of whole numbers are exact, so the order of the rows cannot show in a mean.
    """
    o = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("dataset"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("area"))
    sums = o.join(c, "c_custkey").groupBy("dataset", "area", "month").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("dataset", "area", "month", F.floor(F.col("total").cast("double") / F.col("n")).cast("double").alias("value"))


@query("E-8", f"""
WITH {MONTHLY}
SELECT area, CAST(substr(month, 1, 4) AS INTEGER) AS year, avg(value) AS price FROM monthly GROUP BY 1, 2""")
def yearly_mean(spark, sf):
    return aggregates.yearly_mean(monthly(spark, sf), "area", "month", "value", "price")


@query("E-9", f"""
WITH {MONTHLY} SELECT area, month, avg(value) AS value FROM monthly GROUP BY 1, 2""")
def mean_over_datasets(spark, sf):
    return aggregates.avg_by(monthly(spark, sf), ["area", "month"], "value", "value")


@query("E-10", """
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.5), 6) AS p50,
       round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY 1""")
def quantile_by_group(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    q = distribution.quantile_by(o, ["o_orderpriority"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.withColumns(rounded(6, "p10", "p50", "p90"))


@query("E-10", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90
FROM lineitem GROUP BY 1""")
def quantile_by_narrowing(spark, sf):
    """The same by the way that neither sorts nor shuffles the rows."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    q = distribution.quantile_by(li, ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "p90": 0.9}, one_task_rows=1000)
    return q.withColumns(rounded(6, "q1", "p90"))


DESCRIBE = """count({v}) AS count, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, min({v}) AS min,
  round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS q50,
  round(quantile_cont({v}, 0.75), 6) AS q75, max({v}) AS max"""


@query("E-11", f"SELECT c_mktsegment, {DESCRIBE.format(v='c_acctbal')} FROM customer GROUP BY 1")
def describe_by_group(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    out = distribution.describe_by(c, ["c_mktsegment"], "c_acctbal")
    return out.withColumns(rounded(4, "mean", "std") | rounded(6, "q25", "q50", "q75"))


@query("E-11", f"SELECT {DESCRIBE.format(v='o_totalprice')} FROM orders")
def describe_all(spark, sf):
    out = distribution.describe_by(table(spark, sf, "orders").select("o_totalprice"), [], "o_totalprice")
    return out.withColumns(rounded(4, "mean", "std") | rounded(6, "q25", "q50", "q75"))


SPIKY = "spiky AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice * l_extendedprice / 1000000.0::DOUBLE AS v FROM lineitem)"


def _spiky(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag",
                     (F.col("l_extendedprice") * F.col("l_extendedprice") / 1000000.0).alias("v"))


FENCES = """fences AS (SELECT l_returnflag, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75
  FROM spiky GROUP BY 1), lim AS (SELECT *, q25 - (q75 - q25) * 1.5 AS lo, q75 + (q75 - q25) * 1.5 AS hi FROM fences)"""


@query("E-12", f"""
WITH {SPIKY}, {FENCES}
SELECT l_returnflag, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50, round(any_value(q75), 6) AS q75,
  round(min(CASE WHEN v BETWEEN lo AND hi THEN v END), 6) AS low_whisker, round(max(CASE WHEN v BETWEEN lo AND hi THEN v END), 6) AS high_whisker,
  CAST(sum(CASE WHEN v BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM spiky JOIN lim USING (l_returnflag) GROUP BY 1""")
def box_stats(spark, sf):
    out = distribution.box_stats(_spiky(spark, sf), ["l_returnflag"], "v")
    return out.withColumns(rounded(6, "q25", "q50", "q75", "low_whisker", "high_whisker"))


@query("E-12", f"""
WITH {SPIKY}, {FENCES}
SELECT l_orderkey, l_linenumber, l_returnflag, round(v, 6) AS v FROM spiky JOIN lim USING (l_returnflag) WHERE v < lo OR v > hi""")
def box_outliers(spark, sf):
    return distribution.box_outliers(_spiky(spark, sf), ["l_returnflag"], "v").withColumns(rounded(6, "v"))


@query("C-11", """
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.1) AS cut FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice < cut""")
def below_group_quantile(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return distribution.below_group_quantile(o, ["o_orderpriority"], "o_totalprice", 0.1)


@query("C-11", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < (SELECT quantile_cont(o_totalprice, 0.1) FROM orders)""")
def below_global_quantile(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return distribution.below_group_quantile(o, [], "o_totalprice", 0.1)


HISTOGRAM = """WITH span AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, lo, hi,
  CAST(least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin FROM orders, span)
SELECT {by} bin, round(lo + (hi - lo) * bin / 20, 6) AS "left", round(lo + (hi - lo) * (bin + 1) / 20, 6) AS "right", count(*) AS count
FROM b GROUP BY {by} bin, lo, hi"""


@query("E-13", HISTOGRAM.format(by="year,"))
def histogram_by_year(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return distribution.histogram(o, "o_totalprice", 20, ["year"]).withColumns(rounded(6, "left", "right"))


@query("E-13", HISTOGRAM.format(by=""))
def histogram_all(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice")
    return distribution.histogram(o, "o_totalprice", 20).withColumns(rounded(6, "left", "right"))


@query("E-14", f"""
WITH {CATEGORY_CTE}
SELECT area, year, {", ".join(f"CAST(sum(CASE WHEN category = '{p}' THEN count END) AS BIGINT) AS p{p[0]}" for p in PRIORITIES)}
FROM counts GROUP BY 1, 2""")
def pivot_with_nulls(spark, sf):
    wide = reshape.pivot_counts(category_counts(spark, sf), ["area", "year"], "category", PRIORITIES, "count", fill=None)
    return wide.withColumnsRenamed({p: f"p{p[0]}" for p in PRIORITIES})


@query("E-14", f"""
WITH {CATEGORY_CTE}
SELECT area, year, {", ".join(f"CAST(coalesce(sum(CASE WHEN category = '{p}' THEN count END), 0) AS BIGINT) AS p{p[0]}" for p in PRIORITIES)}
FROM counts WHERE count > 5 GROUP BY 1, 2""")
def pivot_with_zeros(spark, sf):
    long = category_counts(spark, sf).filter("count > 5")
    wide = reshape.pivot_counts(long, ["area", "year"], "category", PRIORITIES, "count")
    return wide.withColumnsRenamed({p: f"p{p[0]}" for p in PRIORITIES})


@query("E-15 A-5", """
SELECT l_orderkey, l_linenumber, 'discount' AS month, l_discount AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem""")
def unpivot_columns(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return reshape.unpivot_periods(li, ["l_orderkey", "l_linenumber"])


@query("E-16", f"""
WITH {MONTHLY}, top AS (SELECT dataset, max(value) AS top FROM monthly WHERE month = '1998-08' GROUP BY 1)
SELECT m.dataset, m.area, m.month, round(value / top, 8) AS value_norm FROM monthly m JOIN top t ON t.dataset = m.dataset""")
def normalize_by_group_max(spark, sf):
    out = reshape.normalize_by_group_max(monthly(spark, sf), "dataset", "month", "1998-08", "value")
    return out.select("dataset", "area", "month", F.round("value_norm", 8).alias("value_norm"))


@query("E-17", f"""
WITH {MONTHLY}, base AS (SELECT dataset, area, value AS b FROM monthly WHERE month = '1998-08')
SELECT m.dataset, m.area, m.month, round(value / b, 8) AS value_norm FROM monthly m LEFT JOIN base x ON x.dataset = m.dataset AND x.area = m.area""")
def normalize_by_own_base(spark, sf):
    out = reshape.normalize_by_base(monthly(spark, sf), ["dataset", "area"], "month", "1998-08", "value")
    return out.select("dataset", "area", "month", F.round("value_norm", 8).alias("value_norm"))


@query("E-18", """
SELECT count(DISTINCT c_nationkey) AS c_nationkey, count(DISTINCT c_mktsegment) AS c_mktsegment FROM customer""")
def distinct_levels(spark, sf):
    return aggregates.count_distinct(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query("E-19", f"""
WITH {PANEL_CTE}
SELECT area, round(avg(n), 6) AS mean_n, round(stddev_samp(n), 6) AS sd_n, round(sum(n) / 8.0::DOUBLE, 6) AS rate_n FROM panel GROUP BY 1""")
def rates_by_area(spark, sf):
    out = aggregates.rate_by(panel(spark, sf), "area", ["n"], 8)
    return out.withColumns(rounded(6, "mean_n", "sd_n", "rate_n"))


@query("E-20 H-2", """
WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p FROM lineitem)
SELECT count(*) AS n, round(sum((y - p) * (y - p)) / count(*), 0) AS mse, round(avg(abs((y - p) / y)) * 100, 6) AS mape,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 8) AS r2, round(1 - abs(avg(p - y)) / (max(y) - min(y)), 8) AS performance
FROM t""")
def prediction_metrics(spark, sf):
    from areapanel.operators.models import baseline

    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("v"))
    m = aggregates.metrics(baseline(li, "v", "p"), "y", "p")
    return m.withColumns(rounded(0, "mse") | rounded(6, "mape") | rounded(8, "r2", "performance"))


@query("E-21", """
SELECT l_returnflag, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2
FROM lineitem GROUP BY 1""")
def regression_line(spark, sf):
    out = aggregates.reg_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.withColumns(rounded(5, "slope") | rounded(4, "intercept") | rounded(8, "r2"))


@query("E-22", f"""
WITH {PANEL_CTE}, r AS (SELECT area, (year - 1997) / 100.0::DOUBLE AS rate FROM panel)
SELECT area, round(product(1 + rate), 10) AS factor FROM r GROUP BY 1""")
def compound_rates(spark, sf):
    r = panel(spark, sf).select("area", ((F.col("year") - 1997) / 100).alias("rate"))
    return aggregates.compound(r, "rate", ["area"]).withColumns(rounded(10, "factor"))


@query("E-23", """
WITH v AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer),
s AS (SELECT g, count(*) AS n, min(v) AS mn, max(v) AS mx,
   0.9::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::DOUBLE) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS bw FROM v GROUP BY g),
d AS (SELECT *, mn - bw * 3 AS lo, (mx - mn + bw * 6) / 127 AS step FROM s),
c AS (SELECT v.g, CAST(least(floor((v - lo) / step), 126) AS INTEGER) AS cell, (v - lo) / step AS pos FROM v JOIN d ON d.g = v.g),
w AS (SELECT g, cell, sum(1 - (pos - cell)) AS w FROM c GROUP BY 1, 2 UNION ALL SELECT g, cell + 1, sum(pos - cell) FROM c GROUP BY 1, 2)
SELECT d.g AS c_mktsegment, CAST(p.point AS INTEGER) AS point, round(lo + step * p.point, 6) AS x,
  round(sum(w.w * exp(-0.5::DOUBLE * pow((p.point - w.cell) * step / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 12) AS density
FROM d JOIN w ON w.g = d.g CROSS JOIN (SELECT unnest(range(128)) AS point) p GROUP BY d.g, p.point, lo, step""")
def kernel_density(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    out = distribution.kde(c, ["c_mktsegment"], "c_acctbal", points=128)
    return out.withColumns(rounded(6, "x") | rounded(12, "density"))


@query("E-24 G-8", """
SELECT DISTINCT trim(unnest(string_split(p_name, ' '))) AS token FROM part""")
def distinct_tokens(spark, sf):
    return aggregates.distinct_tokens(table(spark, sf, "part"), "p_name", " ")


@query("E-26", """
SELECT max(o_totalprice) AS max_price, min(o_totalprice) AS min_price, max(o_custkey) AS max_customer, min(o_custkey) AS min_customer FROM orders""")
def whole_table_extremes(spark, sf):
    return aggregates.max_min(table(spark, sf, "orders"), {"o_totalprice": "price", "o_custkey": "customer"})


@query("E-25", """
SELECT c_nationkey AS area, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def count_of_counts(spark, sf):
    """Counting per (area, name, year) and summing over names is one count per (area, year)."""
    counts = category_counts(spark, sf)
    return counts.groupBy("area", "year").agg(F.sum("count").alias("count"))


@query("G-1 G-2 G-3", f"WITH {PANEL_CTE} SELECT area, year, n FROM panel ORDER BY n DESC, year, area LIMIT 10")
def top_ten(spark, sf):
    return reshape.top_k(panel(spark, sf).select("area", "year", "n"), [F.col("n").desc(), F.col("year"), F.col("area")], 10)


@query("G-4", """
SELECT c_custkey AS id, c_nationkey AS area, 'customer' AS kind, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, 'supplier', NULL FROM supplier""")
def union_of_frames(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("area"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return reshape.concat([c, s], allow_missing=True)


@query("G-5", "SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def distinct_keys(spark, sf):
    return reshape.distinct_on(
        table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year")), ["o_custkey", "year"])


@query("G-6", """
SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS section FROM events""")
def fill_sections(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "event_type", F.when(F.col("event_type") == "error", F.col("event_id")).alias("head"))
    return reshape.fill_sections(e, "head", ["event_id"]).select("event_id", "event_type", "section")


@query("G-6", """
SELECT event_id, event_type, last_value(CASE WHEN event_id % 1000 = 17 THEN event_type || event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id) AS section
FROM events""")
def fill_sections_over_slices(spark, sf):
    """Headers are far apart, and rows lie in more slices than one, so that most slices inherit."""
    head = F.when(F.col("event_id") % 1000 == 17, F.concat("event_type", F.col("event_id").cast("string")))
    e = table(spark, sf, "events").select("event_id", "event_type", head.alias("head"))
    return reshape.fill_sections(e, "head", ["event_id"], file=["event_type"], one_task_rows=0).select("event_id", "event_type", "section")


@query("G-7", """
WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('0:' || o_orderkey::VARCHAR)) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM h""")
def split_train_test(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    train, test = reshape.split_by_share(o, "o_orderkey", 0.8, seed=0)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("G-8", f"""
WITH {AREAS_CTE} SELECT area, trim(unnest(string_split(adjacent, ','))) AS nbr FROM areas""")
def explode_lists(spark, sf):
    return reshape.explode_list(areas(spark, sf).select("area", "adjacent"), "adjacent", "nbr").drop("adjacent")


@query("G-10 C-3", f"WITH {PANEL_CTE} SELECT area, year, n FROM panel WHERE year = 1998")
def one_year(spark, sf):
    from areapanel.sources.tables import by_year

    return by_year(panel(spark, sf).select("area", "year", "n"), 1998)
