"""A fitted forest as a table of nodes: followed in Spark and in SQL, it gives the model's predictions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from areapanel.operators import models


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(800).select("id", (F.rand(1) * 10).alias("a"), (F.rand(2) * 3).alias("b"), F.floor(F.rand(3) * 4).cast("double").alias("c"))
    df = df.withColumn("y", F.sin("a") * 5 + F.col("b") * F.col("c"))
    inputs = ["a", "b", "c"]
    model = models.fit_forest(df, "y", inputs, trees=12, depth=5)
    return df, inputs, model, models.forest_nodes(model, spark)


def test_table_gives_the_models_predictions(fitted):
    df, inputs, model, nodes = fitted
    expect = {r.id: r.predicted for r in models.predict(model, df, inputs).collect()}
    got = {r.id: r.predicted for r in models.predict_from_nodes(df, nodes, inputs, 5).collect()}
    assert got == pytest.approx(expect, rel=1e-12) and len(got) == 800
    deeper = {r.id: r.predicted for r in models.predict_from_nodes(df.limit(20), nodes, inputs, 9).collect()}
    assert all(deeper[i] == pytest.approx(expect[i], rel=1e-12) for i in deeper)


def test_sql_replays_the_table(fitted, tmp_path):
    df, inputs, model, nodes = fitted
    nodes.write.parquet(str(tmp_path / "nodes"))
    df.write.parquet(str(tmp_path / "rows"))
    rows = duckdb.connect().sql(f"""
        WITH RECURSIVE n AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'), r AS (SELECT * FROM '{tmp_path}/rows/*.parquet'),
        w AS (SELECT id, tree, node, feature, threshold, n."left" AS l, n."right" AS r, prediction, a, b, c FROM r CROSS JOIN n WHERE node = 0
          UNION ALL SELECT w.id, w.tree, n.node, n.feature, n.threshold, n."left", n."right", n.prediction, a, b, c FROM w JOIN n ON n.tree = w.tree
            AND n.node = CASE WHEN [a, b, c][w.feature + 1] <= w.threshold THEN w.l ELSE w.r END WHERE w.feature >= 0)
        SELECT id, avg(prediction) FROM w WHERE feature < 0 GROUP BY id""").fetchall()
    expect = {r.id: r.predicted for r in models.predict(model, df, inputs).collect()}
    assert dict(rows) == pytest.approx(expect, rel=1e-12)


def test_rows_without_an_input_have_no_prediction(spark, fitted):
    _, inputs, _, nodes = fitted
    odd = spark.createDataFrame([(1, 1.0, None, 1.0), (2, float("nan"), 1.0, 1.0), (3, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0)], "id int, a double, b double, c double")
    got = sorted(((r.id, r.predicted is None) for r in models.predict_from_nodes(odd, nodes, inputs, 5).collect()))
    assert got == [(1, True), (2, True), (3, False), (3, False)]
    assert models.predict_from_nodes(odd.limit(0), nodes, inputs, 5).count() == 0


def test_one_tree_of_all_rows_cuts_where_the_error_is_least(spark):
    df = spark.createDataFrame([(float(i % 10), 100.0 if i % 10 > 6 else 0.0) for i in range(200)], "a double, y double")
    nodes = models.forest_nodes(models.fit_forest(df, "y", ["a"], trees=1, depth=1, bootstrap=False, inputs_per_split="all"), spark)
    assert nodes.filter("node = 0").first().threshold == 6.5 and nodes.count() == 3
