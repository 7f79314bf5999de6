"""Column functions: the cases that differ between engines."""

import math

import pytest
from pyspark.sql import functions as F

from areapanel.functions import clean, numeric, probability, text


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("value,expect", [("$1,234", 1234.0), ("12", 12.0), ("", None), ("n/a", None), (None, None)])
def test_parse_money(spark, value, expect):
    assert one(spark, value, "string", clean.parse_money) == expect


@pytest.mark.parametrize("value,expect", [("12.3%", 12.3), ("", None), ("x%", None), (None, None)])
def test_parse_percent(spark, value, expect):
    assert one(spark, value, "string", clean.parse_percent) == expect


@pytest.mark.parametrize("value,expect", [("Y", 1), ("N", 0), ("y", 0), (None, 0)])
def test_yes_no(spark, value, expect):
    assert one(spark, value, "string", clean.yes_no) == expect


@pytest.mark.parametrize("value,expect", [("1015-02-04", 1015), ("2010-01-01", 2010), ("abcd", None), (None, None)])
def test_year_prefix(spark, value, expect):
    assert one(spark, value, "string", clean.year_prefix) == expect


@pytest.mark.parametrize("value,expect", [("02/28/2010", 2010), ("13/45/2010", None), (None, None)])
def test_to_year(spark, value, expect):
    assert one(spark, value, "string", lambda c: clean.to_year(c, "MM/dd/yyyy")) == expect


@pytest.mark.parametrize("value,expect", [
    ("1 Main St, New York, NY 10038, USA", "10038"), ("Somewhere", None), (None, None),
    ("NY 10001, USA and NY 10002, USA", "10001")])
def test_extract_zip(spark, value, expect):
    assert one(spark, value, "string", clean.extract_zip) == expect


def test_first_match(spark):
    f = lambda c: clean.first_match(c, clean.extract_zip)
    assert one(spark, ["x", None, "NY 10002, U", "NY 3, U"], "array<string>", f) == "10002"
    assert one(spark, ["x"], "array<string>", f) is None
    assert one(spark, [], "array<string>", f) is None


def test_split_ints(spark):
    assert one(spark, "10018, 10016,x,", "string", clean.split_ints) == [10018, 10016]


def test_bin_labels_and_cap(spark):
    f = lambda c: clean.bin_labels(c, (0, 2), ("0", "1-2", "3+"))
    assert [one(spark, v, "double", f) for v in (0.0, 1.0, 2.0, 3.0, None)] == ["0", "1-2", "1-2", "3+", None]
    assert [one(spark, v, "int", lambda c: numeric.cap(c, 10)) for v in (3, 12, None)] == [3, 10, None]
    assert one(spark, 12, "int", numeric.reverse_scale) == 1
    with pytest.raises(ValueError):
        clean.bin_labels(F.lit(1), (1,), ("a",))


def test_map_labels(spark):
    f = lambda c: clean.map_labels(c, {"gent": "blue"}, "black")
    assert [one(spark, v, "string", f) for v in ("gent", "other", None)] == ["blue", "black", "black"]


def test_logs(spark):
    assert [one(spark, v, "double", numeric.safe_log) for v in (0.0, -1.0, None)] == [None, None, None]
    assert one(spark, math.e, "double", numeric.safe_log) == pytest.approx(1)
    assert one(spark, 0, "int", numeric.log_offset) == pytest.approx(math.log(1.001))


def test_round_half_even(spark):
    assert [one(spark, v, "double", numeric.round_half_even) for v in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_density_of_zero_unit(spark):
    assert one(spark, 0.0, "double", lambda c: numeric.per_unit(F.lit(3), c)) is None


def test_annualize(spark):
    df = spark.createDataFrame([(12, 2017), (12, 2016), (6, 2017)], "v int, y int")
    got = [r[0] for r in df.select(numeric.annualize(F.col("v"), F.col("y"), 2017)).collect()]
    assert got == [13.0, 12.0, 6.0]


def _gamma_cdf(x, a, steps=200_000):
    """Simpson's rule on the density after x = t^2, which removes the pole at 0."""
    def f(t):
        if t == 0:
            return 2 / math.gamma(a) if a == 0.5 else 0.0
        return 2 * math.exp((2 * a - 1) * math.log(t) - t * t - math.lgamma(a))
    top = math.sqrt(x)
    low = max(0.0, math.sqrt(max(0.0, a - 40 * math.sqrt(a)))) if a > 5 else 0.0
    h = (top - low) / steps
    total = f(low) + f(top) + sum((4 if i % 2 else 2) * f(low + i * h) for i in range(1, steps))
    return total * h / 3


def test_gamma_tail_against_integration(spark):
    cases = [(a, a * m) for a in (0.5, 2.0, 50.0, 400.0, 1e4) for m in (0.9, 1.0, 1.05)]
    df = spark.createDataFrame(cases, "a double, t double")
    got = df.select("a", "t", probability.gamma_tail(F.col("t"), F.col("a"), F.lit(1.0)).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(1 - _gamma_cdf(r.t, r.a, 20_000), abs=2e-8)


def test_gamma_tail_edges(spark):
    df = spark.createDataFrame(
        [(0.0, 2.0, 1.0), (-1.0, 2.0, 1.0), (1e6, 2.0, 1.0), (1.0, -1.0, 1.0), (1.0, 2.0, None), (1e-3, 1e4, 1.0)],
        "t double, a double, b double")
    got = [r.p for r in df.select(probability.gamma_tail(F.col("t"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert got[0] == got[1] == 1.0 and got[2] == 0.0 and got[3] is None and got[4] is None and got[5] == 1.0


@pytest.mark.parametrize("shape", [0.5, 100.0, 1e4, 1e6])
def test_gamma_tail_far_out_is_a_number(spark, shape):
    edge = shape + 30 * math.sqrt(shape) + 200
    df = spark.createDataFrame([(edge * m,) for m in (0.98, 0.9999, 1.0001, 1.1, 50.0)], "t double")
    got = [r.p for r in df.select(probability.gamma_tail(F.col("t"), F.lit(shape), F.lit(1.0)).alias("p")).collect()]
    assert all(0 <= p < 1e-6 for p in got), got


def test_gamma_tail_falls_with_threshold(spark):
    df = spark.range(1, 200).select((F.col("id") / 10).alias("t"))
    got = [r.p for r in df.select(probability.gamma_tail(F.col("t"), F.lit(6.0), F.lit(0.8)).alias("p")).collect()]
    assert all(a >= b for a, b in zip(got, got[1:])) and 0 <= got[-1] and got[0] <= 1


def test_compound_path_equals_a_loop(spark):
    got = one(spark, 17.0, "double", lambda c: probability.compound_path(c, F.lit(0.07), 8))
    v, expect = 17.0, []
    for _ in range(8):
        v = float(round(0.07 * v + v))
        expect.append(v)
    assert got == expect


def test_first_paragraph(spark):
    f = text.first_paragraph
    page = "<script>var t='<p>no</p>'</script><p class='a'>One <b>two</b></p><p>Three</p>"
    assert one(spark, page, "string", f) == "One two"
    assert one(spark, "<p>Coordinates: 1</p><p>Text</p>", "string", f) == "Text"
    assert one(spark, "<p>Coordinates: 1</p>", "string", f) is None
    assert one(spark, "<pre>x</pre>", "string", f) is None
    assert one(spark, None, "string", f) is None


def test_sentences(spark):
    assert one(spark, None, "int", lambda c: text.feature_sentence("Number of parks", c)) == "Number of parks: 0"
    assert one(spark, "N/A", "string", text.reason_sentence) is None
    assert "increase" in one(spark, "Low Increase Rate", "string", text.reason_sentence)


def test_rename_refuses_unknown(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        clean.rename(df, {"nope": "x"})
    assert clean.snake_names(df.toDF("﻿Zip Code")).columns == ["zip_code"]
