"""Files: encodings, line ends, byte-order marks, sections, lookups, sinks, and a growing source."""

import json

import pytest
from pyspark.sql import functions as F

from areapanel.plans import crimes, features, forecast, permits, prices, shops
from areapanel.sources import lookups, places, schemas, sinks, store, tables


def test_carriage_return_and_bom(spark, tmp_path):
    f = tmp_path / "price.csv"
    f.write_bytes("﻿Year,ZIP Code,Zillow_value,ZillowAdj,Zillow_value2,ZillowAdj2\r2016,10453,,1.5,2,3\r2017,10453,1,1,1,x\r".encode())
    df = tables.read_table(spark, str(f), schemas.PRICE_YEARLY)
    assert [tuple(r) for r in df.collect()] == [(2016, 10453, None, 1.5, 2.0, 3.0), (2017, 10453, 1.0, 1.0, 1.0, None)]
    keyed = tables.normalize_keys(df)
    assert keyed.columns[:2] == ["year", "area"]
    named = tables.read_named_table(spark, str(f), {"Year": "int", "ZillowAdj": "double"})
    assert [tuple(r) for r in named.collect()] == [(2016, 1.5), (2017, 1.0)]


def test_latin1(spark, tmp_path):
    f = tmp_path / "names.csv"
    f.write_bytes("ZIP,BORO,NEIGHBORHOOD,NAME,WIKILINK\n10001,B,N,Café,x\n".encode("ISO-8859-1"))
    assert tables.read_table(spark, str(f), schemas.ZIP_NAMES, encoding="ISO-8859-1").first().NAME == "Café"


def test_keys_with_decimal_text(spark):
    df = spark.createDataFrame([("10453.0", 2010), ("n/a", 2011), (None, 2012)], "`Zip Code` string, `Filing Year` int")
    assert [r.area for r in tables.normalize_keys(df).orderBy("year").collect()] == [10453, None, None]
    with pytest.raises(ValueError):
        tables.normalize_keys(spark.createDataFrame([(1, 1)], "ZIP int, zipcode int"))


@pytest.mark.parametrize("sep", ["\r", "\n"])
def test_sections(spark, tmp_path, sep):
    f = tmp_path / "series.csv"
    f.write_text("﻿" + sep.join(["Harlem,", "1/3/16,40", "1/10/16,41", "Soho,", "1/3/16,9", ""]), newline="")
    got = [(r.section, str(r.day), r.value) for r in tables.read_sections(spark, str(f), line_sep=sep).orderBy("section", "day").collect()]
    assert got == [("Harlem", "2016-01-03", 40.0), ("Harlem", "2016-01-10", 41.0), ("Soho", "2016-01-03", 9.0)]


def test_features(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"postalCode": z, "PO": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [1, 2]]]}} for z in ("10001", "10002")]}
    f = tmp_path / "areas.geojson"
    f.write_text(json.dumps(doc, indent=1))
    df = tables.feature_property(tables.read_features(spark, str(f)), "postalCode", "area")
    assert sorted(r.area for r in df.collect()) == ["10001", "10002"]
    assert df.first().geometry_type == "Polygon"


def test_places(spark):
    page = lambda n, status="OK": json.dumps({"status": status, "results": [{
        "place_id": "p", "formatted_address": "A, NY 10001, USA", "name": n, "types": ["t"], "geometry": {"location": {"lat": 1.0, "lng": 2.0}}}]})
    df = spark.createDataFrame([(1, page("old")), (2, page("new")), (3, page("x", "OVER_QUERY_LIMIT")), (4, "broken")], "page int, body string")
    flat = places.flatten_places(df, "body")
    assert flat.count() == 2
    assert [(r.name, r.lat, r.lon) for r in places.merge_pages(flat).collect()] == [("new", 1.0, 2.0)]
    assert places.zip_of_results(df.filter("page = 1"), "body").first().zip == "10001"


def test_lookup_grows_without_resolving_twice(spark, tmp_path):
    path, asked = str(tmp_path / "lookup"), []

    def resolve(keys):
        asked.append(sorted(r.k for r in keys.collect()))
        return keys.withColumn("v", F.col("k") * 10)

    df = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    first = lookups.resolve_through_lookup(df, path, ["k"], "k long, v long", resolve)
    assert sorted((r.k, r.v) for r in first.collect()) == [(1, 10), (2, 20), (2, 20)]
    more = df.unionByName(spark.createDataFrame([(3,)], "k long"))
    lookups.resolve_through_lookup(more, path, ["k"], "k long, v long", resolve).collect()
    assert asked == [[1, 2], [3]]
    assert lookups.load_lookup(spark, path, "k long, v long").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2000, 1.0, 2.0), (2, 2001, 3.0, 4.0)], "area int, year int, a double, p double")
    sinks.write_by_year(df, str(tmp_path / "y"))
    assert sorted(p.name for p in (tmp_path / "y").glob("year=*")) == ["year=2000", "year=2001"]
    with pytest.raises(Exception, match="exists|EXISTS"):
        sinks.write_table(df, str(tmp_path / "y"))
    sinks.write_predictions(df, str(tmp_path / "p"), "a", "p")
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == ["year", "area", "actual", "predicted"]
    calls = []

    def build():
        calls.append(1)
        return df

    for _ in range(2):
        assert sinks.build_once(spark, str(tmp_path / "once"), build).count() == 2
    assert len(calls) == 1


def test_permit_pipeline(spark):
    filings = spark.createDataFrame([
        (1, 1, "A1", "01/05/2010", 10), (1, 1, "A1", "03/05/2012", 10), (2, 1, "NB", "02/02/2012", 10), (3, 2, "A1", "02/02/2012", 10),
        (4, 1, "A1", "bad", 10), (5, 1, "A1", "02/02/2010", 99), (6, 1, "XX", "02/02/2010", 10)],
        "job long, doc int, job_type string, filing_date string, area int")
    areas = spark.createDataFrame([(10,), (11,)], "area int")
    counts = permits.permit_counts(filings, areas)
    got = {(r.area, r.year, r.job_type): r["count"] for r in counts.collect()}
    assert len(got) == 2 * 2 * 4 and sum(got.values()) == 2
    assert got[(10, 2010, "A1")] == 1 and got[(10, 2012, "NB")] == 1
    panel = spark.createDataFrame([(10, 2010, 7), (12, 2010, 8)], "area int, year int, A1 int")
    wide = {r.area: r.A1 for r in permits.add_permit_columns(panel, counts).collect()}
    assert wide == {10: 1, 12: None}


def test_crime_pipeline(spark):
    events = spark.createDataFrame([
        (101, 40.69264, -73.94718, "1015-02-04"), (101, 40.69264, -73.94718, "2010-05-05"), (101, 40.69262, -73.94722, "2010-06-05"),
        (101, None, -73.9, "2010-05-05"), (999, 40.7, -73.9, "2010-05-05"), (101, 41.0, -73.0, "2010-01-01")],
        "code int, lat double, lon double, day string")
    codes = spark.createDataFrame([(101,), (101,)], "code int")
    lookup = spark.createDataFrame([("40.6926", "-73.9472", 11206)], "lat_key string, lon_key string, area int")
    found = crimes.violent_events(events, codes)
    assert found.count() == 4
    ready = crimes.with_year(crimes.with_area(found, lambda keys: keys.join(lookup, ["lat_key", "lon_key"])), "day")
    assert [tuple(r) for r in crimes.crime_points(ready).collect()] == [(2010, "40.6926", "-73.9472", 11206, 2)]
    assert [tuple(r) for r in crimes.crime_yearly(ready).collect()] == [(11206, 2010, 2)]
    assert len(set(crimes.VIOLENT_OFFENCES)) == len(crimes.VIOLENT_OFFENCES)


def test_shop_pipeline(spark):
    raw = [
        (1, "A", 10001.0, "2013-05-01", shops.COFFEE, shops.OPENING, 1), (1, "A", 10001.0, "2013-05-01", shops.COFFEE, "Cycle / Initial", 2),
        (1, "A", 10001.0, "2015-05-01", shops.COFFEE, "Cycle / Initial", 3), (2, "B", 10001.0, "2014-05-01", shops.COFFEE, "Cycle / Initial", 4),
        (3, "C", 10001.0, "2014-05-01", "Pizza", shops.OPENING, 5), (4, "D", None, "2014-05-01", shops.COFFEE, shops.OPENING, 6),
        (5, "E", 10001.0, "1900-01-01", shops.COFFEE, shops.OPENING, 7), (6, None, 10001.0, "2014-05-01", shops.COFFEE, shops.OPENING, 8)]
    df = spark.createDataFrame(raw, "shop int, name string, area double, day string, cuisine string, inspection string, line int")
    first = shops.first_inspections(df, [F.col("line")])
    years = (2013, 2014, 2015)
    assert [tuple(r) for r in shops.shop_counts(first, years).collect()] == [(10001.0, 1, 2, 2)]
    assert [tuple(r) for r in shops.shop_counts(first, years, opening=shops.OPENING, cumulative=False).collect()] == [(10001.0, 1, 0, 0)]
    assert [(r.year, r.opened, r.total) for r in shops.shop_counts_long(first).orderBy("year").collect()] == [(2013, 1, 1), (2014, 1, 2)]


def test_price_pipeline(spark):
    wide = spark.createDataFrame(
        [("ZHVI", 1, "c", "s", "m", "n", 1, 2.0, 4.0, None), ("ZHVI", 2, "c", "s", "m", "n", 2, 4.0, 8.0, 2.0),
         ("Median Sale Price per sqft", 1, "c", "s", "m", "n", 1, 9.0, 9.0, 9.0)],
        "Dataset string, RegionName int, City string, State string, Metro string, CountyName string, SizeRank int, "
        "`2016-08` double, `2016-09` double, `2017-01` double")
    long = prices.long_prices(wide)
    assert long.count() == 6
    got = {(r.area, r.year): r["index"] for r in prices.price_index(long, "group").collect()}
    assert got == {(1, 2016): 0.75, (1, 2017): None, (2, 2016): 1.5, (2, 2017): 0.5}
    own = {(r.area, r.year): r["index"] for r in prices.price_index(long, "own").collect()}
    assert own[(1, 2016)] == 1.5 and own[(2, 2017)] == 0.5
    with pytest.raises(ValueError):
        prices.price_index(long, "other")


def test_feature_pipeline(spark):
    panel = spark.createDataFrame([(a, 2014, 100.0 * a, 10.0 * a, float(a), 0.0) for a in range(1, 12)], "area int, year int, income double, price double, x double, y double")
    adj = spark.createDataFrame([(a, f"{a - 1},{a + 1}") for a in range(1, 12)], "area int, adjacent string")
    out = {r.area: r for r in features.add_features(panel, adj, features.cpi_factors(spark)).collect()}
    assert out[5].income_adj == pytest.approx(500.5)
    assert out[5].adjacent_income == pytest.approx(500.5, abs=0.01)
    # Two of eleven areas are at or above the 90th percentile: 10 and 11.
    assert out[3].proximity == pytest.approx(7.0) and out[11].proximity == 0.0


def test_crime_forecast_starts_two_years_on(spark):
    crime = spark.createDataFrame([(1, 2014, 90), (1, 2015, 100), (1, 2016, 110), (2, 2016, 5)], "area int, year int, crime_count int")
    out = forecast.crime_forecast(crime, 2016, 3).orderBy("year").collect()
    g, o = 1 - 100 / 110, (1 - 90 / 110) / 2
    r, a = float(round(g * 110 + 110)), float(round(o * 110 + 110))  # 2017 is the first step, 2018 the second
    for i, row in enumerate(out):
        r, a = float(round(g * r + r)), float(round(o * a + a))
        assert (row.area, row.year, row.count_recent, row.count_overall) == (1, 2018 + i, r, a)
    assert len(out) == 3


def test_columns_are_found_by_name(spark, tmp_path):
    f = tmp_path / "permits.csv"
    f.write_text("BOROUGH,Job Type,Job #,Zip Code,Job doc. #,x,Filing Date,LONGITUDE,LATITUDE\nBX,A1,7,10453.0,1,77,01/02/2010,-73.9,40.8\n")
    row = tables.read_table(spark, str(f), schemas.PERMIT_ISSUANCE, dates={"Filing Date": "MM/dd/yyyy"}).first()
    assert (row["Job #"], row["Job doc. #"], row["Job Type"], row["Zip Code"], row.LATITUDE, row["Filing Date"].year) == (7, 1, "A1", 10453.0, 40.8, 2010)
    (tmp_path / "short.csv").write_text("Job #,Job Type\n1,A1\n")
    with pytest.raises(ValueError, match="Zip Code"):
        tables.read_table(spark, str(tmp_path / "short.csv"), schemas.PERMIT_ISSUANCE)


def test_lookup_needs_no_marker_and_keeps_one_row_per_key(spark, tmp_path):
    path, schema = str(tmp_path / "lookup"), "k long, v long"
    df = spark.createDataFrame([(1,), (2,)], "k long")
    for _ in range(2):
        got = lookups.resolve_through_lookup(df, path, ["k"], schema, lambda keys: keys.withColumn("v", F.col("k") * 10))
        assert sorted((r.k, r.v) for r in got.collect()) == [(1, 10), (2, 20)]
        for marker in (tmp_path / "lookup").rglob("_SUCCESS"):
            marker.unlink()
    lookups.extend_lookup(spark, path, spark.createDataFrame([(3, 5)], schema), ["k"])
    store.append(spark.createDataFrame([(3, 4), (1, 11)], schema), path)  # another run that did not see the key
    assert sorted((r.k, r.v) for r in lookups.load_lookup(spark, path, schema, ["k"]).collect()) == [(1, 10), (2, 20), (3, 4)]
    merged = lookups.merge_lookup(spark.createDataFrame([(1, 1)], schema), spark.createDataFrame([(1, 0), (2, 9), (2, 8)], schema), ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 1), (2, 8)]
