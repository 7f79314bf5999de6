"""Labels partition the rows, and follow the rules in order."""

import pytest
from pyspark.sql import functions as F

from areapanel.plans import areas


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(a, y, 100.0 * a, 10.0 * a * (1 + (y - 2006) * (0.2 if a % 3 == 0 else 0.01))) for a in range(1, 31) for y in (2004, 2006, 2014, 2016)]
    panel = spark.createDataFrame(rows, "area int, year int, income double, price double")
    return areas.label_areas(panel).cache(), panel


def test_reasons_partition_the_rows(labelled):
    df, _ = labelled
    assert df.count() == 60
    counts = {(r.year, r.reason): r["count"] for r in df.groupBy("year", "reason").count().collect()}
    assert counts[(2014, areas.PAST)] == 30
    assert sum(n for (y, _), n in counts.items() if y == 2016) == 30
    assert set(r for y, r in counts if y == 2016) == {areas.ELIGIBLE, areas.HIGH, areas.LOW_INCREASE}


def test_rules(labelled):
    df, _ = labelled
    rows = {r.area: r for r in df.filter("year = 2016").collect()}
    assert rows[3].reason == areas.ELIGIBLE and rows[3]["class"] == "gent"
    assert rows[4].reason == areas.LOW_INCREASE and rows[4]["class"] == "no_low"
    assert rows[15].reason == areas.HIGH and rows[15]["class"] == "no_mid"
    assert rows[30].reason == areas.HIGH and rows[30]["class"] == "no_high"
    assert rows[3].threshold == pytest.approx(rows[3].price_start * (1 + rows[3].top_increase))


def test_probability_and_ranking(labelled):
    df, _ = labelled
    ready = df.withColumns({"alpha": F.lit(9.0), "beta": F.lit(9.0) / F.col("price")})
    p = areas.area_probability(ready)
    for r in p.collect():
        assert (r.probability > 0) == (r.reason == areas.ELIGIBLE)
    top = areas.ranking(p, 2016).orderBy("rank").collect()
    assert [r["rank"] for r in top] == list(range(1, 31))
    assert all(a.probability >= b.probability for a, b in zip(top, top[1:]))
    assert areas.top_area(p, 2016).first().area == top[0].area


def test_bands_same_by_slices(labelled):
    _, panel = labelled
    a = sorted(map(tuple, areas.year_bands(panel).collect()))
    b = sorted(map(tuple, areas.year_bands(panel, one_task_rows=0).collect()))
    assert [x[0] for x in a] == [x[0] for x in b]
    for x, y in zip(a, b):
        assert x == pytest.approx(y)


def test_series_hides_income_after_last_actual_year(labelled):
    _, panel = labelled
    out = {r.year: r for r in areas.area_series(panel, areas.year_bands(panel), 5, 2016).collect()}
    assert out[2014].income == 500.0 and out[2016].income is None and out[2016].income_low is None
    assert out[2016].house_low is not None


def test_slices(spark):
    points = spark.createDataFrame([(1, 2006, 0.0, 0.0, 12), (1, 2006, 1.0, 2.0, 3), (2, 2006, 5.0, 5.0, 1)], "area int, year int, x double, y double, crime_count int")
    from areapanel.plans.crimes import extents

    out = areas.crime_slice(points, extents(points, "x", "y"), 1, 2006).orderBy("x").collect()
    assert [(r.flag, r.total, r.max_y, r.min_x) for r in out] == [("red", 15, 2.0, 0.0), ("grey", 15, 2.0, 0.0)]
    heat = areas.permit_slice(points.withColumnRenamed("crime_count", "num_permits"), 1, 2006).orderBy("x").collect()
    assert [(r.intensity, r.reverse) for r in heat] == [(10, 1), (3, 8)]
    colors = areas.with_colors(spark.createDataFrame([("gent",), (None,)], "class string")).collect()
    assert [r.icon_color for r in colors] == ["blue", "black"]
