"""The tabular preprocessor: places of the vector, options, many categories, and the way back."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from tabloom.operators import prep


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i) if i % 4 else None, ["a", "b", None][i % 3]) for i in range(1, 61)]
    return spark.createDataFrame(rows, "id long, x double, c string")


def vectors(model, df):
    return {r.id: r.v for r in model.transform(df).select("id", vector_to_array("features").alias("v")).collect()}


def test_a_gap_of_a_category_takes_two_places(table):
    model = prep.TabularPreprocessor(inputCols=["x", "c"]).fit(table)
    names = model.feature_names()
    assert names == ["x", "missing_x", "c_a", "c_b", "missing_c_False", "missing_c_True"]
    got = vectors(model, table)
    for i, v in got.items():
        assert len(v) == 6 and v[2:4] == ([0, 1] if i % 3 == 1 else [1, 0]) and v[4:] == ([0, 1] if i % 3 == 2 else [1, 0])


def test_options(table):
    plain = prep.TabularPreprocessor(inputCols=["x", "c"], scaleNumeric=False, categoricalFill="none", addIndicator=False).fit(table)
    assert plain.feature_names() == ["x", "c_a", "c_b", "c_none"]
    got = vectors(plain, table)
    assert got[1] == [1.0, 0, 1, 0] and got[2] == [2.0, 0, 0, 1]
    dropped = prep.TabularPreprocessor(inputCols=["x", "c"], dropHighMissing=0.3).fit(table)
    assert dropped.feature_names()[0] == "x" and not any(n.startswith("c_") for n in dropped.feature_names())
    codes = prep.TabularPreprocessor(inputCols=["c"], encoding="ordinal", addIndicator=False).fit(table)
    assert {tuple(v) for v in vectors(codes, table).values()} == {(0.0,), (1.0,)}


def test_numbers_read_back(table):
    model = prep.TabularPreprocessor(inputCols=["x", "c"]).fit(table)
    rows = model.inverse_numbers(model.transform(table)).where("x is not null").select("x", "inverse.x").toDF("x", "y").collect()
    assert rows and all(r.x == pytest.approx(r.y) for r in rows)


def test_any_number_of_categories(spark):
    n = 60_000
    df = spark.range(n).selectExpr("id", "concat('k', id) AS c", "cast(id AS double) / 3 AS x")
    model = prep.TabularPreprocessor(inputCols=["c", "x"]).fit(df)
    row = model.transform(df).where("id = 5").first()
    assert row.features.size >= n and len(row.features.indices) <= 4
    unseen = spark.createDataFrame([(1, "new", 2.0)], "id long, c string, x double")
    assert np.count_nonzero(model.transform(unseen).first().features.toArray()[1:]) == 0


def test_extra_columns_stay(table):
    model = prep.TabularPreprocessor(inputCols=["c"]).fit(table)
    out = model.transform(table.withColumnRenamed("x", "code"))
    assert out.columns == ["id", "code", "c", "features"] and out.count() == 60


@pytest.mark.parametrize("encoding", ["onehot", "ordinal"])
def test_a_saved_model_needs_nothing_of_its_session(spark, table, tmp_path, encoding):
    import json

    from pyspark.ml import Pipeline

    from tabloom.sources import artifacts

    fitted = Pipeline(stages=[prep.TabularPreprocessor(inputCols=["x", "c"], encoding=encoding)]).fit(table)
    want = vectors(fitted, table)
    artifacts.save_model(fitted, str(tmp_path / "m"))
    own = fitted.stages[0]
    own._set(state=json.dumps(own.info() | {"categories": str(tmp_path / "gone")}))  # as if the shared folder were cleared
    loaded, _, schema = artifacts.load_model(spark, str(tmp_path / "m"))
    assert schema is None and str(tmp_path) in loaded.stages[0].info()["categories"]
    assert vectors(loaded, table) == want and loaded.stages[0].feature_names()[0] == "x"

