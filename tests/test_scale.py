"""The two ways of every size-checked operator give the same result, with a hot group and ties."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from areapanel.operators import scale
from areapanel.operators.distribution import below_group_quantile, box_outliers, box_stats, describe_by, quantile_by
from areapanel.operators.nearest import nearest_in_set
from areapanel.operators.reshape import factor_levels, fill_sections, split_by_share


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, None if i % 97 == 0 else ("hot" if i % 3 else f"g{i % 7}"), float(rng.choice([0, 0, 0, rng.randint(0, 40)])))
            for i in range(1200)]
    return spark.createDataFrame(rows, "id long, g string, v double").cache(), rows


def test_number_rows_both_ways(skewed):
    df, rows = skewed
    order = [F.col("v").desc(), F.col("id").asc()]
    plain = {r.id: r.row for r in scale.number_rows(df, ["g"], order).collect()}
    sliced = {r.id: r.row for r in scale.number_rows(df, ["g"], order, one_task_rows=0).collect()}
    expect = {}
    for g in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            expect[r[0]] = n
    assert plain == expect
    assert sliced == expect


def test_running_sum_both_ways(skewed):
    df, rows = skewed
    order = [F.col("id").asc()]
    for limit in (None, 0):
        got = {r.id: r.running for r in scale.running_sum(df, ["g"], order, "v", one_task_rows=limit).collect()}
        for g in {r[1] for r in rows}:
            total = 0.0
            for r in (r for r in rows if r[1] == g):
                total += r[2]
                assert got[r[0]] == total


def test_global_number_rows(skewed):
    df, rows = skewed
    got = {r.id: r.row for r in scale.number_rows(df, [], [F.col("id").desc()], one_task_rows=0).collect()}
    assert got == {i: 1200 - i for i in range(1200)}


def _quantile(values, p):
    s = sorted(values)
    h = (len(s) - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    return s[lo] + (s[hi] - s[lo]) * (h - lo)


@pytest.mark.parametrize("limit", [None, 0])
def test_quantile_both_ways(skewed, limit):
    df, rows = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in quantile_by(df, ["g"], "v", probs, one_task_rows=limit).collect()}
    assert set(got) == {r[1] for r in rows}
    for g, r in got.items():
        for n, p in probs.items():
            assert r[n] == pytest.approx(_quantile([x[2] for x in rows if x[1] == g], p), abs=1e-12)
    whole = quantile_by(df, [], "v", probs, one_task_rows=limit).collect()
    assert len(whole) == 1
    assert whole[0]["d"] == pytest.approx(_quantile([x[2] for x in rows], 0.9))


def test_quantile_reference_value(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,), (float("nan"),)], "v double")
    for limit in (None, 0):
        assert quantile_by(df, [], "v", {"q": 0.9}, one_task_rows=limit).first()[0] == pytest.approx(6.8)


def test_lookup_join_both_ways(skewed, spark):
    df, rows = skewed
    look = spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = scale.lookup_join(df, look, ["g"], how)
        b = scale.lookup_join(df, look, ["g"], how, limit=0)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert scale.lookup_join(df, look, ["g"], "left").count() == 1200
    with pytest.raises(ValueError):
        scale.lookup_join(df, look, ["g"], "outer")


def test_describe_and_box(skewed):
    df, rows = skewed
    d = {r.g: r for r in describe_by(df, ["g"], "v").collect()}
    values = [r[2] for r in rows if r[1] == "hot"]
    assert d["hot"]["count"] == len(values)
    assert d["hot"].q75 == pytest.approx(_quantile(values, 0.75))
    assert None in d
    b = {r.g: r for r in box_stats(df.filter("g is not null"), ["g"], "v").collect()}
    q1, q3 = _quantile(values, 0.25), _quantile(values, 0.75)
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert b["hot"].high_whisker == max(inside)
    assert b["hot"].outliers == len(values) - len(inside)
    assert box_outliers(df.filter("g = 'hot'"), ["g"], "v").count() == len(values) - len(inside)


def test_below_group_quantile_senses(skewed):
    df, rows = skewed
    df = df.filter("g is not null")
    low = below_group_quantile(df, ["g"], "v", 0.6)
    high = below_group_quantile(df, ["g"], "v", 0.6, at_or_above=True)
    assert low.count() + high.count() == df.count()
    whole = below_group_quantile(df, [], "v", 0.9)
    cut = _quantile([r[2] for r in rows if r[1] is not None], 0.9)
    assert whole.count() == sum(r[2] < cut for r in rows if r[1] is not None)


@pytest.mark.parametrize("lookup_rows", [None, 0])
def test_nearest_against_brute_force(spark, lookup_rows):
    rng = random.Random(3)
    pts = []
    for i in range(400):
        g = 1 if i % 3 else 2
        x, y = (rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) if i % 2 else (rng.uniform(-9, 9), rng.uniform(-3, 3))
        pts.append((i, g, x, y))
    pts += [(400, 1, 0.5, 0.5), (401, 1, 0.5, 0.5), (402, 3, 0.0, 0.0), (403, 1, None, 0.0)]
    members = [p for p in pts if p[0] % 5 == 0 and p[1] != 3 and p[2] is not None]
    schema = "id int, g int, x double, y double"
    got = {r.id: r.proximity for r in nearest_in_set(
        spark.createDataFrame(pts, schema), spark.createDataFrame(members, schema), ["g"], "x", "y", leaf=3,
        lookup_rows=lookup_rows).collect()}
    assert len(got) == len(pts)
    for i, g, x, y in pts:
        same = [m for m in members if m[1] == g]
        if x is None or not same:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(min(math.hypot(x - m[2], y - m[3]) for m in same), abs=1e-12)


def test_nearest_without_members(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "g int, x double, y double")
    assert nearest_in_set(pts, pts.filter("g = 2"), ["g"], "x", "y").first().proximity is None


def test_salted_join_with_hot_and_missing_keys(skewed, spark):
    df, rows = skewed
    look = spark.createDataFrame([("hot", 1), ("g1", 2), ("none", 3), (None, 4)], "g string, w int")
    hot = scale.hot_keys(df, ["g"], fraction=1.0, rows=300)
    assert [r.g for r in hot.collect()] == ["hot"]
    for how in ("left", "inner", "left_semi", "left_anti"):
        expect = sorted(map(str, df.join(look, "g", how).collect()))
        for h in (None, hot):
            assert sorted(map(str, scale.salted_join(df, look, ["g"], how, h, salts=5).collect())) == expect


def test_broadcast_bound_counts_bytes(spark, monkeypatch):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "x" * 1000)], "k int, t string")
    assert "BroadcastHashJoin" in scale.lookup_join(left, right, ["k"])._jdf.queryExecution().toString()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 100)
    for derived in (True, False):
        out = scale.lookup_join(left, right, ["k"], derived=derived)
        assert "_salt" in out._jdf.queryExecution().toString()
        assert {r.k: r.t for r in out.collect()} == {1: "x" * 1000, 2: None}


@pytest.mark.parametrize("limit", [None, 0])
def test_factor_levels_and_split(skewed, limit):
    df, rows = skewed
    codes = {r.g: r.code for r in factor_levels(df, "g", one_task_rows=limit).collect()}
    levels = sorted({r[1] for r in rows if r[1] is not None})
    assert codes == {g: i for i, g in enumerate(levels, 1)}
    train, test = split_by_share(df, "id", 0.8, seed=1)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert len(a) == 960 and not a & b and len(a | b) == 1200


def test_fill_sections(spark):
    rows = [(i, f"s{i}" if i in (3, 4, 17, 41) else None) for i in range(60)]
    df = spark.createDataFrame(rows, "line long, head string")
    for block in (None, F.floor(F.col("line") / 10)):
        got = {r.line: r.section for r in fill_sections(df, "head", ["line"], block).collect()}
        last = None
        for i, h in rows:
            last = h or last
            assert got[i] == last


def test_release_deletes_only_own_tables(spark):
    kept = scale._written[:]
    scale._written.clear()
    df = scale.materialize(spark.range(3))
    folder = df.inputFiles()[0].rsplit("/", 1)[0].replace("file:", "").replace("//", "/")
    assert df.count() == 3 and os.path.isdir(folder)
    assert scale.release(spark) == 1 and not os.path.isdir(folder)
    scale._written.extend(kept)


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        scale.scratch_dir(Session())


def test_quantiles_of_concentrated_and_wide_values(spark):
    rng = random.Random(1)
    values = [0.0] * 300 + [1e-300, 1e300, -1e300, 1.7e308, -1.7e308] + [rng.gauss(0, 1) * 10 ** rng.randint(-30, 30) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.77, "e": 0.999}
    got = quantile_by(df, [], "v", probs, one_task_rows=20).first()
    for n, p in probs.items():
        assert got[n] == pytest.approx(_quantile(values, p), rel=1e-9)


def test_running_sum_past_missing_values(spark):
    rows = [("a", i, None if i < 40 or 60 <= i < 120 else 1) for i in range(160)] + [("b", i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = [sorted((r.g, r.o, r.s) for r in scale.running_sum(df, ["g"], [F.col("o")], "v", "s", one_task_rows=limit).collect())
           for limit in (0, 10**9)]
    assert got[0] == got[1]


def test_lookup_join_keeps_map_columns(spark):
    left = spark.range(50).select((F.col("id") % 3).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    right = spark.range(2).select(F.col("id").alias("k"), F.struct(F.repeat(F.lit("x"), 1000).alias("s")).alias("t"), F.unhex(F.repeat(F.lit("ff"), 500)).alias("b"))
    out = scale.lookup_join(left, right, ["k"], "left", limit=0)
    assert out.count() == 50 and out.filter("t IS NULL").count() == 16
    _, rows, size = scale.materialize_measured(right)
    assert rows == 2 and size >= 2 * 1500


def test_library_runs_on_spark_without_any_configuration(tmp_path):
    import subprocess
    import sys

    code = ("from areapanel.session import local_session; from areapanel.operators import scale; spark = local_session(1);"
            "df = scale.materialize(spark.range(3)); print('rows', df.count(), scale.scratch_dir(spark), spark.conf.get('spark.checkpoint.dir', 'unset'));"
            "print('gone', scale.release(spark))")
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))},
                          capture_output=True, text=True, timeout=300)
    assert "rows 3" in done.stdout and done.stdout.count("unset") == 1 and "gone 1" in done.stdout, done.stderr[-2000:]
