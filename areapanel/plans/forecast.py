"""Model frames, forecasts of the inputs, and scores of the price model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.functions.clean import bin_labels
from areapanel.functions.numeric import annualize, log_offset, per_unit, safe_log
from areapanel.functions.probability import gamma_params, weighted_sum
from areapanel.operators.filters import complete_cases
from areapanel.operators.joins import cross_years, shift_year
from areapanel.operators.models import score_gamma, score_increment
from areapanel.operators.panel import by_area, compound_forecast, forecast_roll, growth_back, growth_overall
from areapanel.operators.sampling import poisson_draws, poisson_value, uniform
from areapanel.operators.scale import lookup_join, materialize
from areapanel.plans import areas
from areapanel.plans.permits import JOB_TYPES, permit_lags, permit_rates

# Classes of subway lines.
LINE_EDGES, LINE_LABELS = (0, 2), ("0", "1-2", "3+")
INPUTS = ("nb_lag1", "a1_lag1", "a2_lag1", "dm_lag2", "proximity")
FRAME = ("area", "year", "price", "prev_price", "borough", "water", "neighborhood", "proximity", "line_class",
         "nb_lag1", "a1_lag1", "a2_lag1", "dm_lag2", "log_prev_crime")


def with_logs(panel: DataFrame) -> DataFrame:
    """Crime density, logarithms and the class of subway lines."""
    return panel.withColumns({
        "log_income": safe_log(F.col("income")),
        "log_crime": safe_log(per_unit(F.col("crime_count"), F.col("land"))),
        "line_class": bin_labels(F.coalesce(F.col("lines"), F.lit(0)), LINE_EDGES, LINE_LABELS),
    })


def training_frame(panel: DataFrame) -> DataFrame:
    """Lagged inputs next to the price; rows with any gap are left out."""
    w = by_area()
    lagged = permit_lags(with_logs(panel)).withColumns({
        "log_prev_crime": F.lag("log_crime").over(w), "log_prev_income": F.lag("log_income").over(w),
        "prev_price": F.lag("price").over(w),
    })
    wanted = [*FRAME, "log_income", "log_prev_income", "dm_lag1", "log_crime"]
    return complete_cases(lagged.select(*wanted)).select(*FRAME).withColumn("intercept", F.lit(1))


def recent_frame(prices: DataFrame, crime: DataFrame, permits: DataFrame, static: DataFrame, years: Sequence[int]) -> DataFrame:
    """The same columns for years after the panel: price and its lag, last year's crime, permit lags, fixed attributes.

    Areas missing in one of the tables drop out, as inner joins do; ``dropped_keys`` counts them.
    """
    priced = prices.withColumn("prev_price", F.lag("price").over(by_area())).filter(F.col("year").isin(list(years)))
    last_crime = shift_year(crime.select("area", "year", "log_prev_crime"), 1)
    lags = permit_lags(permits).select("area", "year", "nb_lag1", "a1_lag1", "a2_lag1", "dm_lag2")
    out = priced.join(last_crime, ["area", "year"]).join(lags, ["area", "year"]).join(static, "area")
    return out.select(*FRAME).withColumn("intercept", F.lit(1))


def model_frame(training: DataFrame, recent: DataFrame) -> DataFrame:
    return recent.unionByName(training)


def crime_forecast(crime: DataFrame, last: int, steps: int) -> DataFrame:
    """Counts carried forward from year ``last`` at the last year's growth and at the average growth.

    ``steps`` rows for each area, from year ``last`` + 2 on, because each forecast is an input of the following year. The
    count of year ``last`` + n has grown n times.
    """
    recent = growth_back(crime.filter(F.col("year").isin(last - 1, last)), "crime_count", "growth")
    overall = growth_overall(crime, "crime_count", "overall_growth")
    start = recent.filter((F.col("year") == last) & F.col("growth").isNotNull()).join(overall, "area")
    paths = compound_forecast(start, "crime_count", {"growth": "count_recent", "overall_growth": "count_overall"}, steps + 1)
    return paths.filter(F.col("year") >= last + 2).select("area", "year", "count_recent", "count_overall")


def crime_densities(ahead: DataFrame, land: DataFrame) -> DataFrame:
    """(area, year, log_recent, log_overall): the logarithms of forecast counts per square mile; areas without a size drop out."""
    joined = ahead.join(land.select("area", "land").distinct(), "area")
    return joined.select("area", "year", *[safe_log(per_unit(F.col(f"count_{k}"), F.col("land"))).alias(f"log_{k}") for k in ("recent", "overall")])


def permit_forecast(rates: DataFrame, years: Sequence[int], seed: int, types: Sequence[str] = ("A1", "A2", "DM", "NB")) -> DataFrame:
    """One Poisson draw per area, year and type at the area's rate."""
    return poisson_draws(rates, {f"rate_{t}": t for t in types}, ["area"], years, seed)


def forecast_frame(static: DataFrame, years: Sequence[int], permits: DataFrame, crime: DataFrame) -> DataFrame:
    """Fixed attributes for every future year, with that year's permit lags and crime."""
    rows = cross_years(static, years)
    return rows.join(permits, ["area", "year"]).join(crime, ["area", "year"])


def roll_scores(
    frame: DataFrame, by_borough: DataFrame, by_neighborhood: DataFrame, inputs: Sequence[str], extra: str, phi: float,
    base: str = "base_price",
) -> DataFrame:
    """Expected price year after year from the base price, with shape and rate of its gamma distribution."""
    scored = score_increment(frame, by_borough, by_neighborhood, "borough", "neighborhood", inputs, extra, base, "_mu")
    rolled = forecast_roll(scored.drop("_mu"), base, "increment", "mu")
    return score_gamma(rolled, "mu", phi)


def path_start(panel: DataFrame, last: int, first_rate_year: int, types: Sequence[str] = JOB_TYPES) -> DataFrame:
    """What a forecast starts from, one row per area: attributes and price of year ``last``, its permits scaled up to a
    whole year, the demolitions of the year before, and yearly permit rates.

    ``panel`` has area, year, price, borough, neighborhood, proximity, land and the permit counts.
    """
    rates = permit_rates(panel.select("area", "year", *types), last, first_rate_year, types).select("area", *[f"rate_{t}" for t in types])
    whole = {t: annualize(F.col(t).cast("double"), F.col("year"), last) for t in types}
    now = panel.filter(F.col("year") == last).withColumns(whole).select(
        "area", "borough", "neighborhood", "proximity", "land", F.col("price").alias("base_price"), *types)
    before = panel.filter(F.col("year") == last - 1).select("area", F.col("DM").cast("double").alias("DM_before"))
    return now.join(before, "area").join(rates, "area")


def forecast_paths(
    start: DataFrame, crime: DataFrame, by_borough: DataFrame, by_neighborhood: DataFrame, by_draw: DataFrame, years: Sequence[int], seed: int,
) -> DataFrame:
    """(area, draw, year, mu, alpha, beta): every area followed through ``years`` under every draw of the parameters.

    start            one row per area, see ``path_start``
    crime            (area, year, log_overall): areas without all ``years`` are left out
    by_borough       (draw, borough, betas of ``INPUTS``, gamma)
    by_neighborhood  (draw, neighborhood, tau)
    by_draw          (draw, phi)

    A path is a fold over the years inside its row. The year's expected price is the last one plus an exponential of the
    permits of earlier years, of crime and of place; then the year's permits are drawn, which depend on seed, area, draw, year
    and type only, and become the next years' lags. Paths meet on lookups only, so nothing is shuffled for them.
    """
    years = [int(y) for y in years]
    crimes = crime.filter(F.col("year").isin(years) & F.col("log_overall").isNotNull()).groupBy("area").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "log_overall"))).alias("_crime")).filter(F.size("_crime") == len(years))
    paths = lookup_join(lookup_join(start, crimes, ["area"], "inner"), by_borough, ["borough"], "inner")
    paths = lookup_join(lookup_join(paths, by_neighborhood, ["draw", "neighborhood"], "inner"), by_draw, ["draw"], "inner")
    demolitions = lambda c: per_unit(c, F.col("land"))
    real = lambda c: c.cast("double")
    begin = F.struct(real(F.col("NB")).alias("nb"), real(F.col("A1")).alias("a1"), real(F.col("A2")).alias("a2"), real(demolitions(F.col("DM"))).alias("dm"),
                     real(demolitions(F.col("DM_before"))).alias("dm_before"), real(F.col("base_price")).alias("mu"),
                     F.array().cast("array<struct<year:int,mu:double>>").alias("out"))

    def step(at: Column, year: Column) -> Column:
        inputs = F.array(log_offset(at["nb"]), log_offset(at["a1"]), log_offset(at["a2"]), log_offset(at["dm_before"]), F.col("proximity").cast("double"))
        mu = at["mu"] + F.exp(weighted_sum(inputs, F.col("betas")) + F.col("gamma") + F.try_element_at("_crime", year) * F.col("tau"))
        drawn = {t: real(poisson_value(uniform([F.col("area"), F.col("draw"), year, F.lit(t)], seed), F.col(f"rate_{t}"))) for t in JOB_TYPES}
        return F.struct(drawn["NB"].alias("nb"), drawn["A1"].alias("a1"), drawn["A2"].alias("a2"), real(demolitions(drawn["DM"])).alias("dm"), at["dm"].alias("dm_before"),
                        mu.alias("mu"), F.concat(at["out"], F.array(F.struct(year.alias("year"), mu.alias("mu")))).alias("out"))

    path = F.aggregate(F.array(*[F.lit(y) for y in years]), begin, step, lambda at: at["out"])
    rows = paths.select("area", "draw", "phi", F.explode(path).alias("_p")).select("area", "draw", F.col("_p.year").alias("year"), F.col("_p.mu").alias("mu"), "phi")
    alpha, beta = gamma_params(F.col("mu"), F.col("phi"))
    return rows.withColumns({"alpha": alpha, "beta": beta}).drop("phi")


def price_forecast(paths: DataFrame) -> DataFrame:
    """(area, year, price, alpha, beta): means over the draws."""
    return paths.groupBy("area", "year").agg(F.avg("mu").alias("price"), F.avg("alpha").alias("alpha"), F.avg("beta").alias("beta"))


def forecast_ranking(panel: DataFrame, paths: DataFrame, span: int, last_actual_year: int, **kw) -> DataFrame:
    """Labels of past and forecast years, with the probability that an eligible area rises past its threshold.

    Forecast prices continue the panel's, so that bands, increases and thresholds of later years follow from both.
    ``areas.ranking`` of a year is the list that is shown.
    """
    ahead = materialize(price_forecast(paths))
    both = panel.select("area", "year", "income", "price").unionByName(ahead.select("area", "year", F.lit(None).cast("double").alias("income"), "price"))
    labels = areas.label_areas(both, span=span, last_actual_year=last_actual_year, **kw)
    return areas.area_probability(lookup_join(labels, ahead.select("area", "year", "alpha", "beta"), ["area", "year"], "inner"))
