"""Parts committed by manifests, folders of files with different headers, and values carried over slices."""

import gzip
import threading

import pytest
from pyspark.sql import functions as F

from areapanel.operators.reshape import fill_sections
from areapanel.sources import lookups, sinks, store, tables


@pytest.fixture
def no_markers(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    yield
    conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_builds_once_without_success_markers(spark, tmp_path, no_markers):
    path, built = str(tmp_path / "once"), []

    def build():
        built.append(1)
        return spark.range(5)

    assert [sinks.build_once(spark, path, build).count() for _ in range(3)] == [5, 5, 5] and len(built) == 1
    assert not list(tmp_path.rglob("_SUCCESS"))


def test_two_builds_at_once_leave_one_table(spark, tmp_path):
    path, gate, got = str(tmp_path / "raced"), threading.Barrier(2, timeout=60), {}

    def run(n):
        def build():
            gate.wait()  # both have seen that there is no table
            return spark.range(10 * n, 10 * n + 3)
        got[n] = sorted(r.id for r in sinks.build_once(spark, path, build).collect())

    runs = [threading.Thread(target=run, args=(n,)) for n in (1, 2)]
    [t.start() for t in runs]
    [t.join() for t in runs]
    kept = sorted(r.id for r in sinks.build_once(spark, path, lambda: 1 / 0).collect())
    assert kept in ([10, 11, 12], [20, 21, 22]) and len(store.manifests(spark, path)) == 1
    assert kept in got.values()
    folders = lambda: len(list((tmp_path / "raced").glob("data-*")))
    before = folders()
    assert store.sweep(spark, path) == 0 and store.sweep(spark, path, 0) == before - 1 and folders() == 1
    assert sinks.build_once(spark, path, lambda: 1 / 0).count() == 3


def test_a_build_that_fails_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "failed")
    with pytest.raises(Exception):
        sinks.build_once(spark, path, lambda: spark.range(9).select(F.raise_error(F.lit("x"))))
    store.write_part(spark.range(7), path)  # as a run leaves it that ends before its commit
    assert not sinks.is_stored(spark, path)
    assert sinks.build_once(spark, path, lambda: spark.range(2)).count() == 2


def test_lookup_parts_with_overlapping_keys(spark, tmp_path, no_markers):
    path, schema = str(tmp_path / "lookup"), "k long, v long"
    assert lookups.load_lookup(spark, path, schema).count() == 0
    first = lookups.extend_lookup(spark, path, spark.createDataFrame([(1, 1), (2, 2), (2, 3)], schema), ["k"])
    lookups.extend_lookup(spark, path, spark.createDataFrame([(2, 9), (3, 3)], schema), ["k"])
    assert lookups.extend_lookup(spark, path, spark.createDataFrame([(3, 4)], schema), ["k"]).count() == 3
    assert len(store.manifests(spark, path)) == 2  # nothing new, no part
    assert sorted(map(tuple, lookups.load_lookup(spark, path, schema, ["k"]).collect())) == [(1, 1), (2, 2), (3, 3)]
    assert first.count() == 2  # what was read before can still be read


def test_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "mixed"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.csv").write_text("x,y\n1,2\n")
    (folder / "b.csv").write_bytes("﻿y,x\r20,10\r21,11\r".encode())
    (folder / "deep" / "c.csv").write_text('extra,"y","x"\r\n"a,b",200,100\r\n')
    with gzip.open(folder / "d.csv.gz", "wt") as f:
        f.write("x,y,x\n7,8,9\n" + "1,1,1\n" * 3)
    (folder / "empty.csv").write_text("")
    (folder / "_hidden.csv").write_text("z\n1\n")
    (folder / "only_header.csv").write_text("y,x")
    expect = sorted([(1, 2), (10, 20), (11, 21), (100, 200), (7, 8), (1, 1), (1, 1), (1, 1)])
    assert sorted(map(tuple, tables.read_table(spark, str(folder), "x int, y int").collect())) == expect
    assert sorted(r.y for r in tables.read_named_table(spark, str(folder), {"y": "long"}).collect()) == sorted(y for _, y in expect)
    some = [str(folder / "a.csv"), str(folder / "b.csv")]
    assert sorted(map(tuple, tables.read_table(spark, some, "x int, y int").collect())) == [(1, 2), (10, 20), (11, 21)]
    assert tables.read_table(spark, str(folder / "*.csv"), "x int, y int").count() == 3


def test_a_file_without_a_wanted_column_is_named(spark, tmp_path):
    (tmp_path / "good.csv").write_text("x,y\n1,2\n")
    (tmp_path / "bad.csv").write_text("x,z\n1,2\n")
    for read in (lambda: tables.read_table(spark, str(tmp_path), "x int, y int"), lambda: tables.read_named_table(spark, str(tmp_path), {"y": "int"})):
        with pytest.raises(ValueError, match=r"\['y'\].*bad\.csv"):
            read()


def test_a_folder_without_files(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path), "x int, y int").count() == 0
    assert tables.read_named_table(spark, str(tmp_path), {"a b": "int"}).columns == ["a b"]


@pytest.mark.parametrize("file", [[], ["f"]])
def test_sections_over_slices_equal_the_window(spark, file):
    rows = [(f, i, f"h{i}" if i % 997 == 5 or i in (40, 41) else None) for f in ("a", None, "b") for i in range(2000) if not (f == "b" and i < 1500)]
    df = spark.createDataFrame(rows, "f string, line int, head string").repartition(6)
    if not file:
        df = df.filter("f = 'a'")
    got = [sorted(map(str, (tuple(r) for r in fill_sections(df, "head", ["line"], file=file, one_task_rows=limit).collect()))) for limit in (0, None)]
    assert got[0] == got[1]
    assert sum("None, None)" in r for r in got[0]) > 0


def test_a_long_file_is_spread_over_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("f").alias("file"), F.col("id").alias("line"), F.when(F.col("id") % 300_000 == 1000, F.col("id")).alias("head"))
    out = fill_sections(df, "head", ["line"], file=["file"], one_task_rows=100_000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 600_000
    expect = F.when(F.col("line") >= 1000, F.floor((F.col("line") - 1000) / 300_000) * 300_000 + 1000)
    assert out.filter(~F.col("section").eqNullSafe(expect)).count() == 0
