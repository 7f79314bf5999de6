"""Column functions and filters on texts made from the tables' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import AREAS_CTE, PANEL_CTE, PRIORITIES, areas, panel, query, table
from areapanel.functions import clean, numeric, text
from areapanel.operators import filters

MONEY = """CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE '$' || CAST(CAST(o_orderkey * 1000 AS BIGINT) AS VARCHAR) || ',' || '125' END"""


@query("B-4", f"""
WITH raw AS (SELECT o_orderkey, {MONEY} AS t FROM orders)
SELECT o_orderkey, t, TRY_CAST(replace(replace(t, '$', ''), ',', '') AS DOUBLE) AS amount FROM raw""")
def parse_money(spark, sf):
    o = table(spark, sf, "orders")
    t = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(
        F.concat(F.lit("$"), (F.col("o_orderkey") * 1000).cast("string"), F.lit(",125")))
    return o.select("o_orderkey", t.alias("t")).withColumn("amount", clean.parse_money(F.col("t")))


@query("B-5", """
SELECT l_orderkey, l_linenumber, TRY_CAST(replace(CAST(CAST(round(l_discount * 1000) AS INTEGER) AS VARCHAR) || '%', '%', '') AS DOUBLE) AS pct
FROM lineitem""")
def parse_percent(spark, sf):
    li = table(spark, sf, "lineitem")
    t = F.concat(F.round(F.col("l_discount") * 1000).cast("int").cast("string"), F.lit("%"))
    return li.select("l_orderkey", "l_linenumber", clean.parse_percent(t).alias("pct"))


@query("B-6", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS open FROM orders")
def yes_no(spark, sf):
    o = table(spark, sf, "orders")
    flag = F.when(F.col("o_orderstatus") == "O", "Y").when(F.col("o_orderstatus") == "F", "N")
    return o.select("o_orderkey", clean.yes_no(flag).alias("open"))


@query("B-7 B-10", """
SELECT p_partkey, trim('  ' || p_brand || ' ') || ' ' || trim(p_name || '  ') AS address FROM part""")
def trim_and_join_words(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", clean.join_words(
        F.concat(F.lit("  "), "p_brand", F.lit(" ")), F.concat("p_name", F.lit("  "))).alias("address"))


@query("B-8", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS number FROM customer")
def digits_only(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean.digits(F.col("c_name")).alias("number"))


@query("B-9 A-10", """
SELECT s_suppkey, round(s_acctbal / 100, 4) AS lat, CAST(round(s_acctbal / 100 * 10000) AS BIGINT) AS lat_grid FROM supplier""")
def geo_keys(spark, sf):
    s = table(spark, sf, "supplier").withColumn("v", F.col("s_acctbal") / 100)
    lat, _ = numeric.geo_key(F.col("v"), F.col("v"))
    return s.select("s_suppkey", lat.cast("double").alias("lat"), numeric.grid_key(F.col("v")).alias("lat_grid"))


ADDRESS = """CASE WHEN s_suppkey % 7 = 0 THEN s_name || ', Somewhere' ELSE s_name || ', Town, NY ' || CAST(10000 + s_suppkey AS VARCHAR) || ', USA' END"""


def _addresses(spark, sf):
    s = table(spark, sf, "supplier")
    full = F.concat("s_name", F.lit(", Town, NY "), (F.col("s_suppkey") + 10000).cast("string"), F.lit(", USA"))
    return s.withColumn("address", F.when(F.col("s_suppkey") % 7 == 0, F.concat("s_name", F.lit(", Somewhere"))).otherwise(full))


@query("B-11", f"""
SELECT s_suppkey, nullif(regexp_extract({ADDRESS}, 'NY (.*?), U', 1), '') AS zip FROM supplier""")
def extract_zip(spark, sf):
    return _addresses(spark, sf).select("s_suppkey", clean.extract_zip(F.col("address")).alias("zip"))


@query("B-12", """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(10000 + s_suppkey AS VARCHAR) ELSE CAST(20000 + s_suppkey AS VARCHAR) END AS zip
FROM supplier""")
def first_matching_result(spark, sf):
    s = _addresses(spark, sf)
    second = F.concat(F.lit("Other, NY "), (F.col("s_suppkey") + 20000).cast("string"), F.lit(", USA"))
    return s.select("s_suppkey", clean.first_match(F.array("address", second), clean.extract_zip).alias("zip"))


@query("B-13", """
SELECT o_orderkey, TRY_CAST(substr(CASE WHEN o_orderkey % 13 = 0 THEN '1015-02-04' WHEN o_orderkey % 17 = 0 THEN 'bad'
  ELSE strftime(o_orderdate, '%Y-%m-%d') END, 1, 4) AS INTEGER) AS year FROM orders""")
def year_prefix(spark, sf):
    o = table(spark, sf, "orders")
    t = (F.when(F.col("o_orderkey") % 13 == 0, "1015-02-04").when(F.col("o_orderkey") % 17 == 0, "bad")
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select("o_orderkey", clean.year_prefix(t).alias("year"))


DATE_TEXT = "CASE WHEN o_orderkey % 19 = 0 THEN '13/45/2010' ELSE strftime(o_orderdate, '%m/%d/%Y') END"


def _date_texts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 19 == 0, "13/45/2010").otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy")).alias("filed"))


@query("B-14 A-4", f"""
SELECT o_orderkey, CAST(year(TRY_STRPTIME({DATE_TEXT}, '%m/%d/%Y')) AS INTEGER) AS year FROM orders""")
def parse_year(spark, sf):
    return _date_texts(spark, sf).select("o_orderkey", clean.to_year(F.col("filed"), "MM/dd/yyyy").alias("year"))


@query("B-15", f"""
SELECT o_orderkey, {DATE_TEXT} AS filed, CAST(TRY_STRPTIME({DATE_TEXT}, '%m/%d/%Y') AS DATE) AS day FROM orders""")
def parse_each_date_once(spark, sf):
    from areapanel.operators.joins import parse_once

    return parse_once(_date_texts(spark, sf), "filed", lambda c: clean.to_day(c, "MM/dd/yyyy"), "day")


@query("B-16", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END, 0) AS amount FROM orders""")
def fill_zero(spark, sf):
    o = table(spark, sf, "orders")
    gap = o.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("amount"))
    return clean.fill_zero(gap, ["amount"])


@query("B-17", """
SELECT p_partkey, CASE WHEN p_size % 6 <= 0 THEN '0' WHEN p_size % 6 <= 2 THEN '1-2' ELSE '3+' END AS class FROM part""")
def bin_labels(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", clean.bin_labels(F.col("p_size") % 6, (0, 2), ("0", "1-2", "3+")).alias("class"))


@query("B-18 B-19", """
SELECT p_partkey, least(p_size, 10) AS capped, 11 - least(p_size, 10) AS reversed FROM part""")
def cap_and_reverse(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", numeric.cap(F.col("p_size"), 10).alias("capped"),
                    numeric.reverse_scale(F.col("p_size"), 10).alias("reversed"))


@query("B-20", "SELECT p_partkey, CASE WHEN p_size >= 10 THEN 'red' ELSE 'grey' END AS color FROM part")
def threshold_flag(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numeric.flag_at_least(F.col("p_size"), 10).alias("color"))


@query("B-21 J-1 J-2", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'blue' WHEN 'MACHINERY' THEN 'green' WHEN 'HOUSEHOLD' THEN 'orange'
  ELSE 'black' END AS color FROM customer""")
def category_labels(spark, sf):
    names = {"BUILDING": "blue", "MACHINERY": "green", "HOUSEHOLD": "orange"}
    return table(spark, sf, "customer").select(
        "c_custkey", clean.map_labels(F.col("c_mktsegment"), names, "black").alias("color"))


@query("B-22", """
SELECT s_suppkey, CASE s_suppkey WHEN 3 THEN 'fixed three' WHEN 8 THEN 'fixed eight' ELSE s_name END AS s_name FROM supplier""")
def row_overrides(spark, sf):
    from areapanel.operators.joins import patch

    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return patch(s, "s_suppkey", {3: "fixed three", 8: "fixed eight"}, "s_name")


@query("B-23 B-32", """
SELECT p_partkey, 'http://maps.example/' || replace(p_name, ' ', '+') AS link FROM part""")
def links(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", clean.prefixed("http://maps.example/", clean.url_key(F.col("p_name"))).alias("link"))


@query("B-24", """
SELECT s_suppkey, round(CASE WHEN s_acctbal - 3000 > 0 THEN ln(s_acctbal - 3000) END, 8) AS log_balance FROM supplier""")
def safe_log(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.round(numeric.safe_log(F.col("s_acctbal") - 3000), 8).alias("log_balance"))


@query("B-25", "SELECT l_orderkey, l_linenumber, round(ln(l_quantity + 1.001), 8) AS log_quantity FROM lineitem")
def offset_log(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numeric.log_offset(F.col("l_quantity")), 8).alias("log_quantity"))


@query("B-26 B-27", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 8) AS unit_price,
       round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 8) AS discount_per_tax FROM lineitem""")
def density_and_ratio(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(numeric.per_unit(F.col("l_extendedprice"), F.col("l_quantity")), 8).alias("unit_price"),
        F.round(numeric.ratio(F.col("l_discount"), F.col("l_tax")), 8).alias("discount_per_tax"))


@query("B-28", """
SELECT p_partkey, round_even(p_size / 2.0::DOUBLE, 0) AS whole, round_even(p_size / 8.0::DOUBLE, 2) AS two FROM part""")
def round_half_even(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", numeric.round_half_even(F.col("p_size") / 2).alias("whole"),
        numeric.round_half_even(F.col("p_size") / 8, 2).alias("two"))


@query("B-29", f"""
WITH {AREAS_CTE}
SELECT area, CAST(list_sum(list_transform(string_split(adjacent, ','), lambda x: CAST(trim(x) AS INTEGER))) AS BIGINT) AS total,
       CAST(len(string_split(adjacent, ',')) AS INTEGER) AS items FROM areas""")
def split_int_lists(spark, sf):
    a = areas(spark, sf).withColumn("ints", clean.split_ints(F.col("adjacent")))
    total = F.aggregate("ints", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return a.select("area", total.alias("total"), F.size("ints").alias("items"))


@query("B-30", """
SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS brand_no, TRY_CAST(p_name AS INTEGER) AS name_no FROM part""")
def cast_columns(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", clean.digits(F.col("p_brand")).alias("brand_no"), F.col("p_name").alias("name_no"))
    return clean.cast_cols(p, ["brand_no", "name_no"], "int")


@query("B-31", """
SELECT vec_id, round(sqrt((embedding[1]::DOUBLE - embedding[3]::DOUBLE) * (embedding[1]::DOUBLE - embedding[3]::DOUBLE)
     + (embedding[2]::DOUBLE - embedding[4]::DOUBLE) * (embedding[2]::DOUBLE - embedding[4]::DOUBLE)), 9) AS distance FROM embeddings""")
def distance_in_degrees(spark, sf):
    e = table(spark, sf, "embeddings")
    c = [F.col("embedding")[i].cast("double") for i in range(4)]
    return e.select("vec_id", F.round(numeric.euclid(c[0], c[1], c[2], c[3]), 9).alias("distance"))


@query("B-1 B-2 B-3 B-33 G-9", """
SELECT o_orderkey AS job, o_custkey AS owner, o_orderstatus AS status, 1 AS intercept FROM orders""")
def select_drop_rename(spark, sf):
    o = table(spark, sf, "orders")
    kept = clean.drop_cols(o, ["o_totalprice", "o_orderdate"])
    kept = kept.select(*clean.cols_except(kept, ["o_orderpriority"]))
    named = clean.rename(kept, {"o_orderkey": "job", "o_custkey": "owner", "o_orderstatus": "status"})
    return named.withColumn("intercept", F.lit(1))


@query("B-34", f"""
WITH {PANEL_CTE}
SELECT area, year, 'Probability for area ' || area::VARCHAR || ' over ' || (year - 5)::VARCHAR || ' to ' || year::VARCHAR AS sentence,
       'orders: ' || n::VARCHAR AS feature FROM panel""")
def sentences(spark, sf):
    p = panel(spark, sf)
    return p.select("area", "year", text.area_sentence(F.col("area"), F.col("year") - 5, F.col("year")).alias("sentence"),
                    text.feature_sentence("orders", F.col("n")).alias("feature"))


@query("C-1 C-2 C-3", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority FROM orders
WHERE (o_orderstatus = 'O' OR o_orderstatus = 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'""")
def category_and_year_filters(spark, sf):
    from areapanel.operators.joins import when_any

    o = table(spark, sf, "orders")
    either = when_any([F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"])
    # The year range is stated on the stored column, so that it reaches the scan.
    dates = (F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))) & (
        F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")))
    kept = o.filter(either & F.col("o_orderpriority").isin(list(PRIORITIES[:2])) & dates)
    return filters.between_years(
        kept.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority"), 1996, 1999)


@query("C-4", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS category FROM orders)
SELECT o_orderkey, category FROM t WHERE category IS DISTINCT FROM '5-LOW'""")
def not_this_value(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("category"))
    return filters.not_value(o, "category", "5-LOW")


@query("C-5 C-8", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS a,
                  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS b FROM orders)
SELECT o_orderkey, a, b FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")
def complete_cases(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("a"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("b"))
    return filters.complete_cases(o)


@query("C-6", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""")
def rows_with_listed_code(spark, sf):
    codes = table(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # The codes are listed twice; a semi-join does not care.
    return filters.semi_filter(li, codes.unionByName(codes), "l_partkey").select("l_orderkey", "l_linenumber")


@query("C-7", """
SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def keys_in_other_table(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return filters.semi_filter(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), big, "c_custkey")


@query("C-9", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000.0")
def outlier_bound(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_totalprice") < 250000.0).select("o_orderkey", "o_totalprice")


@query("C-10", """
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber = 1 AND l_returnflag IN ('A', 'R')""")
def first_versions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return filters.first_versions(li, "l_linenumber", F.col("l_returnflag").isin("A", "R"))


@query("C-12", """
SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0""")
def unresolved_rows(spark, sf):
    a = _addresses(spark, sf).withColumn("zip", clean.extract_zip(F.col("address")))
    return filters.unresolved(a, "zip").select("s_suppkey")
