"""Joins, lookups, grids and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import (
    AREAS_CTE, CATEGORY_CTE, PANEL_CTE, PRIORITIES, YEARS, areas, category_counts, panel, query, table,
)
from areapanel.operators import joins


@query("D-1 D-2 A-1", f"""
WITH {PANEL_CTE}, {AREAS_CTE}
SELECT p.area, p.year, p.n, a.name, a.land FROM panel p LEFT JOIN areas a ON a.area = p.area AND a.area < 20""")
def enrich_left(spark, sf):
    attributes = areas(spark, sf).filter("area < 20").withColumnRenamed("area", "area_key")
    out = joins.enrich(panel(spark, sf), attributes, {"area": "area_key"}, ["name", "land"], expect_unique=True)
    return out.select("area", "year", "n", "name", "land")


@query("D-3", """
SELECT l_orderkey, l_linenumber, s_nationkey AS area, p_type FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""")
def inner_joins(spark, sf):
    from areapanel.operators.scale import lookup_join

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    both = lookup_join(lookup_join(li, s, ["l_suppkey"], "inner", derived=False), p, ["l_partkey"], "inner", derived=False)
    return both.select("l_orderkey", "l_linenumber", "area", "p_type")


@query("D-4", f"""
WITH {PANEL_CTE}
SELECT p.area, p.year, p.n, q.n AS n_before FROM panel p JOIN panel q ON q.area = p.area AND q.year = p.year - 1""")
def lagged_join(spark, sf):
    p = panel(spark, sf).select("area", "year", "n")
    return joins.lagged_join(p, p.withColumnRenamed("n", "n_before"))


@query("D-5", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def missing_keys(spark, sf):
    seen = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_keys(table(spark, sf, "customer"), seen, ["c_custkey"])


@query("D-6", """
SELECT l_orderkey, l_linenumber, s_nationkey AS area FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 12""")
def enrich_distinct_keys(spark, sf):
    s = table(spark, sf, "supplier").filter("s_nationkey < 12").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    out = joins.enrich_distinct(li, ["l_suppkey"], lambda keys: keys.join(s, "l_suppkey"))
    return out.select("l_orderkey", "l_linenumber", "area")


@query("D-7 B-29", f"""
WITH {PANEL_CTE}, {AREAS_CTE},
edges AS (SELECT area, CAST(trim(unnest(string_split(adjacent, ','))) AS INTEGER) AS nbr FROM areas),
m AS (SELECT p.area, p.year, round_even(avg(q.n), 2) AS adjacent_n FROM panel p JOIN edges e ON e.area = p.area
      JOIN panel q ON q.area = e.nbr AND q.year = p.year GROUP BY 1, 2)
SELECT p.area, p.year, p.n, m.adjacent_n FROM panel p LEFT JOIN m ON m.area = p.area AND m.year = p.year""")
def neighbor_average(spark, sf):
    return joins.neighbor_avg(panel(spark, sf).select("area", "year", "n"), areas(spark, sf), {"n": "adjacent_n"})


GAPS_CTE = PANEL_CTE + """, gaps AS (
  SELECT area, year, CASE WHEN (area + year) % 3 = 0 THEN NULL ELSE n END AS v FROM panel WHERE (area * 7 + year) % 5 <> 0)"""


def _gaps(spark, sf):
    p = panel(spark, sf).filter((F.col("area") * 7 + F.col("year")) % 5 != 0)
    return p.select("area", "year", F.when((F.col("area") + F.col("year")) % 3 != 0, F.col("n")).alias("v"))


def _gap_sql(mean: str) -> str:
    return f"""
WITH {GAPS_CTE}, {AREAS_CTE},
edges AS (SELECT area, CAST(trim(unnest(string_split(adjacent, ','))) AS INTEGER) AS nbr FROM areas),
m AS (SELECT p.area, p.year, {mean} AS adjacent_v FROM gaps p JOIN edges e ON e.area = p.area
      JOIN gaps q ON q.area = e.nbr AND q.year = p.year GROUP BY 1, 2)
SELECT p.area, p.year, p.v, m.adjacent_v FROM gaps p LEFT JOIN m ON m.area = p.area AND m.year = p.year"""


@query("D-7", _gap_sql("round_even(avg(q.v), 2)"))
def neighbor_average_gaps(spark, sf):
    return joins.neighbor_avg(_gaps(spark, sf), areas(spark, sf), {"v": "adjacent_v"})


@query("D-7", _gap_sql("CASE WHEN count(q.v) = count(*) THEN round_even(avg(q.v), 2) END"))
def neighbor_average_strict(spark, sf):
    return joins.neighbor_avg(_gaps(spark, sf), areas(spark, sf), {"v": "adjacent_v"}, strict=True)


@query("D-8", """
WITH pts AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v FROM embeddings),
cut AS (SELECT label, quantile_cont(v, 0.9) AS q FROM pts GROUP BY label),
top AS (SELECT p.label, x, y FROM pts p JOIN cut c ON c.label = p.label WHERE v >= q)
SELECT p.vec_id, p.label, round(min(sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y))), 10) AS proximity
FROM pts p JOIN top t ON t.label = p.label GROUP BY 1, 2""")
def nearest_top_member(spark, sf):
    from areapanel.operators.nearest import proximity_to_top

    e = table(spark, sf, "embeddings")
    c = [F.col("embedding")[i].cast("double") for i in range(3)]
    pts = e.select("vec_id", "label", c[0].alias("x"), c[1].alias("y"), c[2].alias("v"))
    out = proximity_to_top(pts, "v", "x", "y", year="label")
    return out.select("vec_id", "label", F.round("proximity", 10).alias("proximity"))


@query("D-8", """
WITH pts AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice AS x, (o_orderkey % 97)::DOUBLE AS y, o_custkey % 5 = 0 AS member FROM orders),
m AS (SELECT g, x, y FROM pts WHERE member UNION ALL SELECT DISTINCT g, 1e12, -1e12 FROM pts)
SELECT p.o_orderkey, round(min(sqrt((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y))), 6) AS proximity
FROM pts p JOIN m ON m.g = p.g WHERE p.o_orderkey % 4 = 1 GROUP BY 1""")
def nearest_with_far_member(spark, sf):
    """One member of each group lies very far from all others."""
    from areapanel.operators.nearest import nearest_in_set

    o = table(spark, sf, "orders")
    pts = o.select("o_orderkey", F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y"),
                   (F.col("o_custkey") % 5 == 0).alias("member"))
    far = pts.select("g").distinct().withColumns({"x": F.lit(1e12), "y": F.lit(-1e12)})
    members = pts.filter("member").select("g", "x", "y").unionByName(far)
    out = nearest_in_set(pts.filter("o_orderkey % 4 = 1"), members, ["g"], "x", "y")
    return out.select("o_orderkey", F.round("proximity", 6).alias("proximity"))


@query("D-9 G-11", f"""
WITH dated AS (SELECT c_nationkey AS area, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey),
big AS (SELECT area, year, category, count(*) FILTER (WHERE o_totalprice > 400000) AS count FROM dated GROUP BY 1, 2, 3
  HAVING count(*) FILTER (WHERE o_totalprice > 400000) > 0)
SELECT n_nationkey AS area, y.year, p.category, coalesce(big.count, 0) AS count
FROM nation CROSS JOIN (SELECT DISTINCT year FROM dated) y CROSS JOIN (SELECT DISTINCT category FROM dated) p
LEFT JOIN big ON big.area = n_nationkey AND big.year = y.year AND big.category = p.category""")
def complete_grid(spark, sf):
    big = F.when(F.col("o_totalprice") > 400000, 1).otherwise(0)
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"),
                                           F.col("o_orderpriority").alias("category")).agg(F.sum(big).alias("count"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("area"))
    counts = o.join(c, "c_custkey").groupBy("area", "year", "category").agg(F.sum("count").alias("count"))
    from areapanel.operators.scale import materialize

    counts = materialize(counts)
    dims = {"year": counts, "category": counts}
    return joins.complete_grid(counts.filter("count > 0"), areas(spark, sf), dims)


@query("D-10", """
SELECT n_nationkey AS area, n_name AS name, y.year FROM nation CROSS JOIN (SELECT unnest([2002, 2003, 2004, 2005]) AS year) y""")
def rows_for_future_years(spark, sf):
    return joins.cross_years(areas(spark, sf).select("area", "name"), range(2002, 2006))


@query("D-11", f"""
WITH t AS (SELECT c_nationkey AS area, CASE WHEN max(c_acctbal) > 9990 THEN 'rich' ELSE 'other' END AS class FROM customer
           WHERE c_nationkey <> 4 AND c_nationkey <> 9 GROUP BY 1)
SELECT n_nationkey AS area, n_name AS name, coalesce(class, 'gray') AS class FROM nation LEFT JOIN t ON t.area = n_nationkey""")
def features_with_default(spark, sf):
    c = table(spark, sf, "customer").filter("c_nationkey NOT IN (4, 9)").groupBy(F.col("c_nationkey").alias("area")).agg(
        F.when(F.max("c_acctbal") > 9990, "rich").otherwise("other").alias("class"))
    return joins.join_features(areas(spark, sf).select("area", "name"), c, "area", "class", "gray")


@query("D-12 D-13", f"""
WITH {PANEL_CTE}
SELECT p.area, p.year, p.n, q.n AS n_in_2 FROM panel p JOIN panel q ON q.area = p.area AND q.year = p.year + 2""")
def target_two_years_ahead(spark, sf):
    return joins.with_value_at(panel(spark, sf).select("area", "year", "n"), "n", 2, "n_in_2")


@query("D-14", f"""
WITH {PANEL_CTE}
SELECT p.area, p.year, p.n, q.n AS n_next FROM panel p LEFT JOIN panel q ON q.area = p.area AND q.year = p.year + 1""")
def input_next_year(spark, sf):
    return joins.with_value_at(panel(spark, sf).select("area", "year", "n"), "n", 1, "n_next", how="left")


@query("D-15", """
SELECT c_custkey, n_name AS description FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def dictionary_lookup(spark, sf):
    names = areas(spark, sf).select(F.col("area").alias("c_nationkey"), F.col("name").alias("description"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return joins.describe_key(c, names, "c_nationkey").select("c_custkey", "description")


@query("D-16", f"""
WITH {AREAS_CTE}, place AS (SELECT s_nationkey AS area, avg(s_acctbal) AS x FROM supplier GROUP BY 1),
feat AS (SELECT c_nationkey AS area, count(*) AS shops FROM customer GROUP BY 1)
SELECT a.area, a.name, a.borough, f.shops, round(p.x, 6) AS x FROM areas a LEFT JOIN feat f ON f.area = a.area
LEFT JOIN place p ON p.area = a.area WHERE a.area = 7""")
def area_profile(spark, sf):
    from areapanel.plans.areas import area_profile as profile

    place = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.avg("s_acctbal").alias("x"))
    feat = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("shops"))
    out = profile(7, areas(spark, sf).select("area", "name", "borough"), feat, place)
    return out.withColumn("x", F.round("x", 6))


@query("D-3", """
WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT 'left' AS side, count(*) AS n FROM l WHERE k NOT IN (SELECT k FROM r)
UNION ALL SELECT 'right', count(*) FROM r WHERE k NOT IN (SELECT k FROM l)""")
def keys_an_inner_join_drops(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return joins.dropped_keys(left, right, ["k"])


@query("A-6", """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'first' ELSE 'second' END AS source FROM customer""")
def merged_lookup(spark, sf):
    from areapanel.sources.lookups import merge_lookup

    c = table(spark, sf, "customer")
    old = c.filter("c_acctbal > 5000").select("c_custkey", F.lit("first").alias("source"))
    return merge_lookup(old, c.select("c_custkey", F.lit("second").alias("source")), ["c_custkey"])


@query("D-9 E-14", f"""
WITH {CATEGORY_CTE}
SELECT n_nationkey AS area, y AS year, {", ".join(f"CAST(coalesce(sum(CASE WHEN category = '{p}' THEN count END), 0) AS BIGINT) AS p{p[0]}" for p in PRIORITIES)}
FROM nation CROSS JOIN (SELECT unnest([{", ".join(map(str, YEARS))}]) AS y) LEFT JOIN counts ON area = n_nationkey AND year = y
GROUP BY 1, 2""")
def grid_then_pivot(spark, sf):
    from areapanel.operators.reshape import pivot_counts

    grid = joins.complete_grid(category_counts(spark, sf), areas(spark, sf), {"year": YEARS, "category": PRIORITIES})
    wide = pivot_counts(grid, ["area", "year"], "category", list(PRIORITIES), "count")
    return wide.withColumnsRenamed({p: f"p{p[0]}" for p in PRIORITIES})
