"""Deep forests: the same trees whether a task grows them whole or the tasks split their upper nodes together."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import explain, forest, models, treeshap
from tabloom.operators.treeshap import Trees, tree_shap


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 3)), 2)
    y = np.where(x[:, 0] > 0, 2 * x[:, 1], x[:, 2]) + 5
    df = spark.createDataFrame(pd.DataFrame({"id": range(1500), "label": y, "v": x.tolist()}), "id bigint, label double, v array<double>")
    return df.select("id", "label", array_to_vector("v").alias("features")).cache()


@pytest.mark.parametrize("bootstrap", [True, False])
@pytest.mark.parametrize("classes", [0, 2])
def test_upper_nodes_split_together_change_no_tree(rows, classes, bootstrap):
    df = rows.withColumn("label", (F.col("label") > 5).cast("double")) if classes else rows
    cuts = forest.feature_cuts(df)
    got = [forest.fit_forest(df, 4, 30, classes, 2, 1, cuts, bootstrap, tasks=t, node_rows=n).transform(df).select("id", "prediction").orderBy("id").toPandas()
           for t, n in ((1, 10_000), (3, 100))]
    assert len(got[0]) == 1500 and np.allclose(got[0]["prediction"], got[1]["prediction"])


def test_one_tree_of_all_rows_reaches_its_training_labels(rows):
    x = vector_to_array("features")
    cuts = forest.feature_cuts(rows)
    cell = forest.cells_of(cuts)(x).alias("c")
    out = forest.fit_forest(rows, 1, 30, 0, 3, 1, cuts, bootstrap=False).transform(rows)
    best = rows.groupBy(cell).agg(F.avg("label").alias("want"))
    wrong = out.withColumn("c", forest.cells_of(cuts)(x)).join(best, "c").where(F.abs(F.col("want") - F.col("prediction")) > 1e-6)
    assert wrong.count() == 0


def test_equal_rows_beyond_a_task_are_one_leaf(spark):
    df = spark.range(900).select("id", (F.col("id") % 3).cast("double").alias("label"), array_to_vector(F.array(F.lit(1.0))).alias("features"))
    out = forest.fit_forest(df, 3, 30, 3, 1, 1, [np.array([0.5])], node_rows=100).transform(df).agg(F.count("*"), F.max(F.size("probability"))).first()
    assert out[0] == 900 and out[1] == 3


def test_contributions_and_importances_come_from_the_grown_trees(rows, spark):
    cuts = forest.feature_cuts(rows)
    model = forest.fit_forest(rows, 3, 30, 0, 3, 1, cuts, node_rows=300)
    few = rows.where("id < 20")
    trees = Trees.of(model, spark)
    total = tree_shap(few, trees, ["a", "b", "c"]).groupBy("id").agg(F.sum("shap_value").alias("s"))
    far = model.transform(few).join(total, "id").agg(F.max(F.abs(F.col("prediction") - F.col("s") - trees.expected[0]))).first()[0]
    assert far < 1e-6
    assert model.featureImportances.toArray().sum() == pytest.approx(1)


def test_the_registry_takes_rows_in_any_number_of_tasks(rows):
    trained = models.fit_forest_regressor(rows, {"n_estimators": 10})
    error = trained.score(rows).agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0]
    assert error < 0.5


@pytest.mark.parametrize("classes, cells", [(0, 2_000_000), (2, 2_000_000), (3, 500)])
def test_contributions_by_sets_equal_those_by_leaves(rows, spark, monkeypatch, classes, cells):
    monkeypatch.setattr(treeshap, "TABLE_CELLS", cells)
    df = rows.withColumn("label", F.least(F.greatest(F.floor("label") - 4, F.lit(0)), F.lit(classes - 1)).cast("double")) if classes else rows
    model = forest.fit_forest(df, 4, 30, classes, 2, 1, forest.feature_cuts(df), node_rows=300)
    few = rows.where("id < 40")
    names = ["a", "b", "c"]
    which = int(classes == 2)
    want = {(r["id"], r["feature"]): r["shap_value"] for r in tree_shap(few, Trees.of(model, spark), names, which).collect()}
    monkeypatch.setattr(Trees, "of", None)  # the whole forest in one place
    out = explain.shap_values(models.Trained(model.transform, model), few, names, F.col("prediction"))
    got = {(r["id"], r["feature"]): r["shap_value"] for r in out.collect()}
    assert len(got) == 120 and got == pytest.approx(want, abs=1e-9)
