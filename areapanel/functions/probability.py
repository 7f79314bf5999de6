"""Gamma distribution as native column expressions, and the moment map of the price model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_params(mu: Column, phi: Column) -> tuple[Column, Column]:
    """(shape, rate) of the gamma distribution with mean ``mu`` and variance ``phi``."""
    return mu * mu / phi, mu / phi


def ln_gamma(x: Column, shift: int = 10) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + shift, brought back by the product x(x+1)...(x+shift-1)."""
    z = x + F.lit(float(shift))
    product = x
    for i in range(1, shift):
        product = product * (x + F.lit(float(i)))
    series = (
        F.lit(1.0) / (z * 12.0) - F.lit(1.0) / (z * z * z * 360.0) + F.lit(1.0) / (z * z * z * z * z * 1260.0)
        - F.lit(1.0) / (z * z * z * z * z * z * z * 1680.0)
    )
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)


def gamma_cdf(threshold: Column, shape: Column, rate: Column) -> Column:
    """P(X <= threshold): the lower incomplete gamma series, summed inside the row.

    With z = rate * threshold the k-th term is z^k / ((a+1)...(a+k)); terms grow until a + k passes z and then
    shrink, so max(0, z - a) + 10 sqrt(z) + 50 of them reach double precision. When z is far above the shape
    the probability is 1 to the last digit and no term is needed.
    """
    z = rate * threshold
    far = z > shape + F.sqrt(shape) * 30.0 + 200.0
    span = F.when(far, F.lit(0.0)).otherwise(F.greatest(z - shape, F.lit(0.0)) + F.sqrt(z) * 10.0 + 50.0)
    steps = F.sequence(F.lit(1), F.ceil(span).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def grow(acc: Column, k: Column) -> Column:
        term = acc["term"] * z / (shape + k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    # With z at most 30 deviations (and 200) above the shape, the sum stays below about e^460, inside the double range.
    total = F.aggregate(steps, start, grow, lambda acc: acc["total"])
    front = F.exp(shape * F.ln(z) - z - ln_gamma(shape + F.lit(1.0)))
    value = F.when(far, F.lit(1.0)).otherwise(F.least(F.lit(1.0), front * total))
    return F.when((shape > 0) & (rate > 0), F.when(threshold > 0, value).otherwise(F.lit(0.0)))


def gamma_tail(threshold: Column, shape: Column, rate: Column) -> Column:
    """P(X > threshold)."""
    return F.lit(1.0) - gamma_cdf(threshold, shape, rate)


def tail_percent(threshold: Column, shape: Column, rate: Column) -> Column:
    """The tail probability in whole percent, rounded half to even."""
    return F.bround(gamma_tail(threshold, shape, rate) * 100.0)


def weighted_sum(values: Column, weights: Column) -> Column:
    """Sum of products of two arrays of the same length."""
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def compound_path(value: Column, growth: Column, steps: int) -> Column:
    """[v1, v2, ...]: ``v * (1 + growth)`` step after step, rounding half to even each time."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.array(value.cast("double")),
        lambda acc, _: F.concat(acc, F.array(F.bround(growth * F.element_at(acc, -1) + F.element_at(acc, -1)))),
        lambda acc: F.slice(acc, 2, steps),
    )
