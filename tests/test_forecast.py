"""The forecast's fold against a plain loop over areas, draws and years."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from areapanel.plans import forecast

YEARS = range(2018, 2023)


def drawn(seed, area, draw, year, kind, rate):
    """The smallest count whose cumulative probability reaches the uniform number of the key."""
    u = int(hashlib.md5(f"{seed}:{area}:{draw}:{year}:{kind}".encode()).hexdigest()[:13], 16) / (1 << 52)
    if rate == 0:
        return 0
    k, p = 0, math.exp(-rate)
    total = p
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.fixture(scope="module")
def tables(spark):
    panel = [(a, y, 100.0 + a, 3, f"n{a % 2}", a / 10, 1.5 + a, 12 * a + y % 5, 7 + a, 3, 2 * a + y % 3) for a in (1, 2, 3) for y in range(2010, 2018)]
    panel = spark.createDataFrame([(a, y, p, b, n, x, land, nb, a1, a2, dm) for a, y, p, b, n, x, land, nb, a1, a2, dm in panel],
                                  "area int, year int, price double, borough int, neighborhood string, proximity double, land double, NB long, A1 long, A2 long, DM long")
    crime = spark.createDataFrame([(a, y, 0.1 * a + (y - 2018) / 10) for a in (1, 2, 3) for y in YEARS if (a, y) != (3, 2020)] + [(1, 2030, 9.0)], "area int, year int, log_overall double")
    boroughs = spark.createDataFrame([(d, 3, [0.1 * d, 0.02, -0.03, 0.05, 0.2], -1.0 - d) for d in range(4)], "draw int, borough int, betas array<double>, gamma double")
    hoods = spark.createDataFrame([(d, f"n{n}", 0.3 * n - 0.1 * d) for d in range(4) for n in (0, 1)], "draw int, neighborhood string, tau double")
    phis = spark.createDataFrame([(d, 0.5 + d) for d in range(4)], "draw int, phi double")
    return panel, crime, boroughs, hoods, phis


def loop(panel, crime, boroughs, hoods, phis, seed):
    rows = {(r.area, r.year): r for r in panel.collect()}
    crimes = {(r.area, r.year): r.log_overall for r in crime.collect()}
    outer, inner, phi = {r.draw: r for r in boroughs.collect()}, {(r.draw, r.neighborhood): r.tau for r in hoods.collect()}, {r.draw: r.phi for r in phis.collect()}
    out = {}
    for area in (1, 2):  # the third has no crime forecast for one year
        now = rows[area, 2017]
        whole = lambda y, t: round(rows[area, y][t] * 13 / 12) if y == 2017 else rows[area, y][t]
        rate = {t: sum(whole(y, t) for y in range(2010, 2018)) / 8 for t in ("NB", "A1", "A2", "DM")}
        for d in range(4):
            last, before, mu = {t: whole(2017, t) for t in rate}, rows[area, 2016]["DM"], now.price
            for y in YEARS:
                x = [math.log(last["NB"] + 1.001), math.log(last["A1"] + 1.001), math.log(last["A2"] + 1.001), math.log(before / now.land + 1.001), now.proximity]
                mu += math.exp(sum(a * b for a, b in zip(x, outer[d].betas)) + outer[d].gamma + crimes[area, y] * inner[d, now.neighborhood])
                out[area, d, y] = (mu, mu * mu / phi[d], mu / phi[d])
                before, last = last["DM"], {t: drawn(seed, area, d, y, t, rate[t]) for t in rate}
    return out


def test_paths_equal_a_loop(tables):
    panel, crime, *draws = tables
    got = forecast.forecast_paths(forecast.path_start(panel, 2017, 2010), crime, *draws, YEARS, seed=9)
    expect = loop(panel, crime, *draws, 9)
    rows = {(r.area, r.draw, r.year): (r.mu, r.alpha, r.beta) for r in got.repartition(5).collect()}
    assert set(rows) == set(expect)
    for k, v in expect.items():
        assert rows[k] == pytest.approx(v, rel=1e-10)


def test_forecast_is_the_mean_over_draws_and_later_years_follow_drawn_permits(tables):
    panel, crime, *draws = tables
    start = forecast.path_start(panel, 2017, 2010)
    runs = [{(r.area, r.draw, r.year): r.mu for r in forecast.forecast_paths(start, crime, *draws, YEARS, seed=s).collect()} for s in (1, 2)]
    assert all(runs[0][k] == runs[1][k] for k in runs[0] if k[2] == 2018)  # observed permits only
    assert any(runs[0][k] != runs[1][k] for k in runs[0] if k[2] == 2019)
    mean = {(r.area, r.year): r.price for r in forecast.price_forecast(forecast.forecast_paths(start, crime, *draws, YEARS, seed=1)).collect()}
    for (area, year), price in mean.items():
        assert price == pytest.approx(sum(runs[0][area, d, year] for d in range(4)) / 4)


def test_no_rows(tables, spark):
    panel, crime, *draws = tables
    start = forecast.path_start(panel, 2017, 2010)
    assert forecast.forecast_paths(start, crime.limit(0), *draws, YEARS, seed=1).count() == 0
    assert forecast.price_forecast(forecast.forecast_paths(start.limit(0), crime, *draws, YEARS, seed=1)).count() == 0
