"""Readers, lookups and sinks: what goes through a file comes back the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import PANEL_CTE, panel, query, table
from areapanel.operators.scale import scratch_path
from areapanel.sources import lookups, places, sinks, store, tables


def _path(spark) -> str:
    return scratch_path(spark)


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_NAMES = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("A-1 A-11", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    path = _path(spark)
    sinks.write_table(table(spark, sf, "customer"), path, "csv")
    return tables.read_table(spark, path, CUSTOMER)


@query("A-1", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def mixed_header_csv(spark, sf):
    """A folder whose files have their columns in three orders, one with a further column."""
    path, c = _path(spark), table(spark, sf, "customer")
    orders = [["c_mktsegment", "c_acctbal", "c_nationkey", "c_name", "c_custkey"], ["c_name", "c_custkey", "c_phone", "c_acctbal", "c_mktsegment", "c_nationkey"], CUSTOMER_NAMES]
    for n, names in enumerate(orders):
        part = c.filter(F.col("c_custkey") % 3 == n).withColumn("c_phone", F.lit("555"))
        sinks.write_table(part.select(*names), path, "csv", "append")
    return tables.read_table(spark, path, CUSTOMER)


@query("A-6", "SELECT c_custkey, c_nationkey AS area FROM customer")
def lookup_in_parts(spark, sf):
    """Three extensions, with keys that overlap, and a part that was never committed: each key is read once."""
    path = _path(spark)
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("area"))
    for keys in ("c_custkey % 3 = 0", "c_custkey % 2 = 0", "true"):
        lookups.extend_lookup(spark, path, c.filter(keys), ["c_custkey"])
    store.write_part(c.withColumn("area", F.lit(-1)), path)
    return lookups.load_lookup(spark, path, c.schema)


@query("A-2", "SELECT c_custkey, 'Café ' || c_name AS c_name FROM customer")
def latin1_csv(spark, sf):
    path = _path(spark)
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Café "), "c_name").alias("c_name"))
    c.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.read_table(spark, path, c.schema, encoding="ISO-8859-1")


@query("A-3", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def carriage_return_csv(spark, sf):
    path = _path(spark)
    table(spark, sf, "customer").write.option("header", True).option("lineSep", "\r").csv(path)
    return tables.read_table(spark, path, CUSTOMER)


@query("A-4", """
SELECT o_orderkey, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS filed FROM orders""")
def csv_with_dates(spark, sf):
    path = _path(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 19 == 0, "13/45/2010").otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy")).alias("filed"))
    sinks.write_table(o, path, "csv")
    return tables.read_table(spark, path, o.schema, dates={"filed": "MM/dd/yyyy"})


@query("A-12", f"WITH {PANEL_CTE} SELECT area, n, year FROM panel WHERE year = 1999")
def written_by_year(spark, sf):
    """Only the directory of one year is read."""
    path = _path(spark)
    sinks.write_by_year(panel(spark, sf).select("area", "n", "year"), path)
    schema = "area int, n long, year int"
    return tables.by_year(spark.read.schema(schema).parquet(path), 1999)


@query("A-13", f"WITH {PANEL_CTE} SELECT area, year, n FROM panel")
def built_once(spark, sf):
    path = _path(spark)
    sinks.build_once(spark, path, lambda: panel(spark, sf).select("area", "year", "n"))

    def never():
        raise AssertionError("the stored table is there")

    return sinks.build_once(spark, path, never)


@query("A-14", f"""
WITH {PANEL_CTE} SELECT p.year, p.area, q.price AS actual, p.price AS predicted FROM panel p JOIN panel q ON q.area = p.area AND q.year = p.year + 2""")
def written_predictions(spark, sf):
    from areapanel.operators.joins import with_value_at
    from areapanel.operators.models import baseline

    path = _path(spark)
    rows = baseline(with_value_at(panel(spark, sf), "price", 2, "target"), "price")
    sinks.write_predictions(rows, path, "target", "predicted")
    schema = "year int, area int, actual double, predicted double"
    return tables.read_table(spark, path, schema)


@query("A-6 D-5 D-6", """
SELECT o_orderkey, c_nationkey AS area FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def resolved_through_lookup(spark, sf):
    """A first run stores half of the keys; the second resolves and stores only the rest."""
    path = _path(spark)
    schema = "o_custkey long, area int"
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("area"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lookups.extend_lookup(spark, path, c.filter("o_custkey % 2 = 0"), ["o_custkey"])
    out = lookups.resolve_through_lookup(o, path, ["o_custkey"], schema, lambda keys: keys.join(c, "o_custkey"))
    return out.select("o_orderkey", "area")


def _pages(spark, sf):
    """One page of results per supplier and page number, as JSON text: two places each, every ninth page failed."""
    s = table(spark, sf, "supplier").withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))

    def place(shift):
        key = (F.col("s_suppkey") + shift).cast("string")
        return F.struct(
            F.concat(F.lit("p"), key).alias("place_id"), F.concat(F.lit("Town, NY "), (F.col("s_suppkey") + 10000).cast("string"), F.lit(", USA")).alias("formatted_address"),
            F.concat("s_name", F.lit(" page "), F.col("page").cast("string")).alias("name"), F.array(F.lit("store"), F.lit("point")).alias("types"),
            F.struct(F.struct(F.col("s_acctbal").alias("lat"), (F.col("s_acctbal") / 2).alias("lng")).alias("location")).alias("geometry"))

    status = F.when(F.col("s_suppkey") % 9 == 0, "ZERO_RESULTS").otherwise("OK")
    return s.select("page", "s_suppkey", F.to_json(F.struct(status.alias("status"), F.array(place(0), place(1)).alias("results"))).alias("body"))


PLACES = """places AS (SELECT g.page, s_suppkey, 'p' || CAST(s_suppkey + k.i AS VARCHAR) AS place_id, 'Town, NY ' || CAST(10000 + s_suppkey AS VARCHAR) || ', USA' AS address,
  s_name || ' page ' || CAST(g.page AS VARCHAR) AS name, s_acctbal AS lat, s_acctbal / 2 AS lon FROM supplier
  CROSS JOIN (SELECT unnest([1, 2]) AS page) g CROSS JOIN (SELECT unnest([0, 1]) AS i) k WHERE s_suppkey % 9 <> 0)"""


@query("A-7", f"WITH {PLACES} SELECT page, place_id, address, name, lat, lon FROM places")
def flattened_places(spark, sf):
    return places.flatten_places(_pages(spark, sf), "body").drop("types", "s_suppkey")


@query("A-8", f"""
WITH {PLACES} SELECT place_id, name FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY s_suppkey * 10 + page DESC) AS r FROM places) WHERE r = 1""")
def merged_pages(spark, sf):
    flat = places.flatten_places(_pages(spark, sf), "body").withColumn("seq", F.col("s_suppkey") * 10 + F.col("page"))
    return places.merge_pages(flat, page="seq").select("place_id", "name")


@query("B-12 A-7", """
SELECT s_suppkey, page, CAST(10000 + s_suppkey AS VARCHAR) AS zip FROM supplier CROSS JOIN (SELECT unnest([1, 2]) AS page)""")
def zip_of_results(spark, sf):
    return places.zip_of_results(_pages(spark, sf), "body").select("s_suppkey", "page", "zip")


@query("A-9 D-11", """
SELECT CAST(n_nationkey AS VARCHAR) AS area, n_name AS name, 'Polygon' AS geometry_type FROM nation""")
def map_features(spark, sf):
    n = table(spark, sf, "nation")
    feature = F.struct(
        F.struct(F.col("n_nationkey").cast("string").alias("postalCode"), F.col("n_name").alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.col("n_nationkey"), F.lit(1))).alias("coordinates")).alias("geometry"))
    docs = n.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("doc"))
    flat = tables.flatten_features(docs, "doc")
    named = tables.feature_property(tables.feature_property(flat, "postalCode", "area"), "name", "name")
    return named.select("area", "name", "geometry_type")


@query("A-9", """
SELECT CAST(n_nationkey AS VARCHAR) AS area, n_name AS name, 'Polygon' AS geometry_type FROM nation""")
def map_features_file(spark, sf):
    """The collection as a file, pretty-printed over several lines as such files are."""
    feature = F.struct(
        F.struct(F.col("n_nationkey").cast("string").alias("postalCode"), F.col("n_name").alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.col("n_nationkey"), F.lit(1))).alias("coordinates")).alias("geometry"))
    whole = table(spark, sf, "nation").agg(F.to_json(F.struct(F.collect_list(feature).alias("features")), {"pretty": "true"}).alias("value"))
    path = _path(spark)
    whole.write.text(path)
    named = tables.feature_property(tables.feature_property(tables.read_features(spark, path), "postalCode", "area"), "name", "name")
    return named.select("area", "name", "geometry_type")


@query("A-15", r"""
WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS ps FROM pages),
t AS (SELECT page_id, list_transform(ps, lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS ts FROM b)
SELECT page_id, CASE WHEN contains(ts[1], 'Coordinates:') THEN ts[2] ELSE ts[1] END AS description FROM t""")
def first_paragraphs(spark, sf):
    return places.describe_pages(table(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", "description")
