"""Forests of rows with few different inputs are grown from sums: same trees, every cut, every row drawn."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from areapanel.operators import models
from areapanel.operators.forest import places


@pytest.fixture(scope="module")
def few(spark):
    df = spark.range(6_000).select((F.col("id") % 60).cast("double").alias("a"), (F.floor(F.rand(3) * 7) / 2).alias("b"), F.rand(4).alias("e"))
    return df.withColumn("y", F.when(F.col("a") > 40, 10).otherwise(0) + F.col("b") * F.col("a") / 20 + F.col("e")).localCheckpoint()


def test_every_cut_is_looked_at(spark):
    df = spark.range(6_000).select((F.col("id") % 60).cast("double").alias("a"))
    for last in (16, 17, 40, 41):
        cut = df.withColumn("y", F.when(F.col("a") > last, 1.0).otherwise(0.0))
        nodes = models.forest_nodes(models.fit_forest(cut, "y", ["a"], trees=1, depth=1, bootstrap=False, inputs_per_split="all"), spark)
        assert nodes.filter("node = 0").first().threshold == last + 0.5


def test_one_tree_is_spark_mls(spark, few):
    coarse = few.withColumn("a", F.floor(F.col("a") / 3))
    model = models.fit_forest(coarse, "y", ["a", "b"], trees=1, depth=4, bootstrap=False)
    other = RandomForestRegressor(featuresCol=models.FEATURES, labelCol="y", predictionCol="predicted", numTrees=1, maxDepth=4, bootstrap=False).fit(
        models.assemble(coarse, ["a", "b"]))
    columns = ["node", "feature", "threshold", "left", "right"]
    got, expect = (models.forest_nodes(m, spark).orderBy("node").collect() for m in (model, other))
    assert [[r[c] for c in columns] for r in got] == [[r[c] for c in columns] for r in expect]
    assert [r["prediction"] for r in got] == pytest.approx([r["prediction"] for r in expect], rel=1e-9)
    assert model.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray(), rel=1e-9)


def test_trees_draw_all_rows_anew(spark, few):
    model = models.fit_forest(few, "y", ["a", "b"], trees=300, depth=3)
    assert model.getNumTrees == 300 and len(model.trees) == 300
    drawn = np.array([t._call_java("rootNode").impurityStats().count() for t in model.trees])
    # Poisson numbers of mean 1 for 6,000 rows: mean 6,000, standard deviation 77.
    assert abs(drawn.mean() - 6_000) < 25 and 65 < drawn.std() < 90
    again = models.fit_forest(few, "y", ["a", "b"], trees=300, depth=3)
    assert again.featureImportances.toArray() == pytest.approx(model.featureImportances.toArray(), rel=1e-9)
    assert model.featureImportances[0] > 0.6


def test_odd_rows_are_left_to_spark_ml(spark, few):
    assert len(places(few, "y", ["a", "b"], 500)) == 420
    assert places(few, "y", ["a", "e"], 500) is None
    assert places(few.limit(50), "y", ["a", "b"], 500, 100) is None
    missing = few.withColumn("a", F.when(F.col("a") < 30, F.col("a")))
    assert len(places(missing, "y", ["a", "b"], 500)) == 210
    assert places(few.withColumn("y", F.when(F.col("a") < 30, F.col("y"))), "y", ["a", "b"], 500) is None
    assert places(few.withColumn("a", F.lit(float("inf"))), "y", ["a", "b"], 500) is None


def test_few_inputs_are_asked_once(spark, few):
    model = models.fit_forest(few, "y", ["a", "b"], trees=5, depth=3)
    odd = few.limit(40).unionByName(spark.createDataFrame([(None, 1.0, 0.5, 3.0), (float("nan"), 1.0, 0.5, 3.0), (7.0, 1.0, 0.5, 3.0)], few.schema))
    got = models.predict(model, odd, ["a", "b"])
    assert got.columns == ["a", "b", "e", "y", "predicted"]
    expect = model.transform(models.assemble(odd, ["a", "b"])).drop(models.FEATURES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expect.collect())) and got.count() == 41
