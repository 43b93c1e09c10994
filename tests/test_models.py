"""Models, forecasts and explanations against closed forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import automl, explain, forecast, models, sampling
from tabloom.operators import timeseries as ts
from tabloom.plans import model_plans


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([2.0, -1.0, 0.5]) + 3 + rng.normal(0, 0.1, 200)
    return x, y, table(spark, x, y)


def table(spark, x, y):
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(y)), "label": y.astype(float), "v": x.tolist()}),
                               "id bigint, label double, v array<double>")
    return df.select("id", "label", array_to_vector("v").alias("features")).cache()


def test_ridge_closed_form(linear):
    x, y, df = linear
    m = models.fit_ridge(df, {"alpha": 1.0}).model
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def coordinate_descent(x, y, alpha, l1):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    b, n = np.zeros(x.shape[1]), len(y)
    for _ in range(2000):
        for j in range(len(b)):
            r = yc - xc @ b + xc[:, j] * b[j]
            rho = xc[:, j] @ r / n
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - l1))
    return b


@pytest.mark.parametrize("fit,l1", [(models.fit_lasso, 1.0), (models.fit_elasticnet, 0.5)])
def test_sparse_linear(linear, fit, l1):
    x, y, df = linear
    m = fit(df, {"alpha": 0.3, "l1_ratio": l1, "max_iter": 2000}).model
    assert np.allclose(m.coefficients.toArray(), coordinate_descent(x, y, 0.3, l1), atol=1e-4)


def test_adaboost_matches_weighted_stumps(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (300, 2)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 5) ^ (x[:, 0] == 3)).astype(float)
    got = models.fit_adaboost_classifier(table(spark, x, y), {"n_estimators": 12}).score(table(spark, x, y)).orderBy("id").toPandas()
    w, votes = np.ones(300), np.zeros((300, 2))
    for _ in range(12):
        best = None
        for f in (0, 1):
            for c in sorted(set(x[:, f]))[:-1]:
                side = x[:, f] <= c
                a, b = [np.array([w[s & (y == k)].sum() for k in (0, 1)]) for s in (side, ~side)]
                pure = (a ** 2).sum() / a.sum() + (b ** 2).sum() / b.sum()
                if best is None or pure > best[0] + 1e-12:
                    best = (pure, np.where(side, a.argmax(), b.argmax()))
        p = best[1]
        err = w[p != y].sum() / w.sum()
        if err >= 0.5:
            break
        alpha = np.log((1 - err) / err)
        votes[np.arange(300), p] += alpha
        w = w * np.where(p != y, np.exp(alpha), 1) / w.sum()
    agree = (got["prediction"].to_numpy() == votes.argmax(axis=1)).mean()
    assert agree == 1.0


def test_automl_ranks_and_votes(linear):
    _, _, df = linear
    board, trained = automl.automl(df, False, ["linear_regression", "ridge", "lasso", "xgboost"], 3, {"max_depth": 3})
    rows = {r["model"]: r for r in board.collect()}
    assert rows["linear_regression"]["score"] > 0.95 and rows["linear_regression"]["rank"] <= 2
    assert rows["xgboost"]["status"] == "unavailable" and rows["xgboost"]["score"] is None
    out = automl.ensemble_top3(df, False, board, trained).first()
    assert out["vote"] == "mean" and out["score"] > 0.5
    with pytest.raises(ValueError):
        automl.automl(df, False, ["ridge"], None, {"epochs": 0})


def test_config_is_copied():
    entry = models.CLASSIFIERS["random_forest"]
    assert models.with_config(entry, {"n_estimators": 7, "max_depth": 3}) == {"n_estimators": 7}
    assert entry.params == {"n_estimators": 100}
    assert models.check_config({"learning_rate": 0, "max_depth": True, "epochs": 10}) == ["learning_rate", "max_depth"]


def test_smote_balances(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(120, 2)), (np.arange(120) % 8 == 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(120), "label": y, "a": x[:, 0], "b": x[:, 1]}))
    out = sampling.smote(df, "id", "label", ["a", "b"]).toPandas()
    assert set(out["label"].value_counts()) == {105}
    new = out[out["copy"] > 0]
    old = x[y == 1]
    assert new["a"].between(old[:, 0].min(), old[:, 0].max()).all()


def test_generated_rows_ignore_partitions(spark):
    spec = [{"name": "a", "type": "numeric"}, {"name": "t", "type": "text"}, {"name": "d", "type": "date"}]
    one = sampling.generate_table(spark.range(0, 50, 1, 1), spec).collect()
    assert sorted(map(str, one)) == sorted(map(str, sampling.generate_table(spark.range(0, 50, 1, 7), spec).collect()))


# ---- forecasting ----

def series(spark, y, name="s"):
    t = pd.date_range("2024-01-01", periods=len(y), freq="h")
    return spark.createDataFrame(pd.DataFrame({"series": name, "ts": t, "y": y})).cache()


def test_arima_recovers_ar1(spark):
    rng = np.random.default_rng(0)
    y = [0.0]
    for _ in range(3000):
        y.append(0.7 * y[-1] + rng.normal())
    df = series(spark, y)
    assert forecast.adf_order(df, ["series"], "ts", "y").first()["d"] == 0
    fit = forecast.arima_fit(df, ["series"], "ts", "y", order=(1, 0))
    r = fit.first()
    assert r["ar"][0] == pytest.approx(0.7, abs=0.05) and r["sigma2"] == pytest.approx(1.0, abs=0.1)
    ahead = forecast.arima_forecast(df, ["series"], "ts", "y", fit, 3).orderBy("step").toPandas()
    m = y[-1]
    for h in range(3):
        m = r["const"] + r["ar"][0] * m
        assert ahead["mean"][h] == pytest.approx(m)
        spread = np.sqrt(r["sigma2"] * sum(r["ar"][0] ** (2 * i) for i in range(h + 1)))
        assert ahead["upper"][h] - m == pytest.approx(1.959964 * spread, rel=1e-5)


def test_random_walk_needs_a_difference(spark):
    y = np.random.default_rng(2).normal(size=1500).cumsum()
    assert forecast.adf_order(series(spark, y), ["series"], "ts", "y").first()["d"] == 1


def test_seasonal_fit_follows_a_daily_wave(spark):
    t = np.arange(24 * 30)
    y = 50 + 0.02 * t + 5 * np.sin(2 * np.pi * t / 24)
    df = series(spark, y)
    fits = forecast.seasonal_fit(df, ["series"], "ts", "y", ["weekly", "daily"])
    out = forecast.seasonal_forecast(fits, ["series"], "ts", 24, "H", ["weekly", "daily"]).orderBy("ts").toPandas()
    t2 = np.arange(24 * 30, 24 * 31)
    assert np.allclose(out["yhat"], 50 + 0.02 * t2 + 5 * np.sin(2 * np.pi * t2 / 24), atol=0.5)
    parts = forecast.seasonal_components(df, ["series"], "ts", fits, ["weekly", "daily"]).toPandas()
    assert parts["daily"].max() == pytest.approx(5, abs=0.3)


def test_lookback_extends_a_line(spark):
    out = forecast.lookback_regression(series(spark, np.arange(200.0)), ["series"], "ts", "y", 4, 3).orderBy("step").toPandas()
    assert np.allclose(out["yhat"], [200, 201, 202], atol=1e-2)


def test_rolling_origin(spark):
    t = np.arange(24 * 40)
    out = forecast.rolling_origin_cv(series(spark, 10 + np.sin(2 * np.pi * t / 24)), ["series"], "ts", "y", 20, 5, 5, ["daily"])
    assert out.count() == 3 and out.agg(F.max("rmse")).first()[0] < 0.2


# ---- explanations ----

def test_sampled_contributions_add_up(linear):
    x, _, df = linear
    trained = models.fit_linear(df, {})
    phi = explain.shap_sampled(trained.score, F.col("prediction"), df.where("id < 20"), ["a", "b", "c"], permutations=40, background=20)
    wide = phi.groupBy("id").pivot("feature").agg(F.first("shap_value")).orderBy("id").toPandas()
    back = x[:20].mean(axis=0)
    want = (x[:20] - back) * trained.model.coefficients.toArray()
    assert np.abs(wide[["a", "b", "c"]].to_numpy() - want).mean() < 0.35


def test_permutation_importance_orders_features(linear):
    _, _, df = linear
    out = explain.permutation_importance(models.fit_linear(df, {}).score, df, ["a", "b", "c"], False, 3)
    assert [r["feature"] for r in out.orderBy(F.desc("importance")).collect()] == ["a", "b", "c"]


def test_clipping_removes_spikes(spark):
    y = np.random.default_rng(0).normal(100, 10, 1000)
    y[0], y[-1] = 99999, -99999
    out = ts.winsorize(series(spark, y), ["series"], ["y"]).agg(F.max("y"), F.min("y")).first()
    assert out[0] < 1000 and out[1] > -1000


def test_balanced_training_part(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, int(i % 10 == 0), Vectors.dense([float(i % 10), float(i % 7)])) for i in range(100)]
    train = spark.createDataFrame(rows, ["id", "label", "features"])
    counts = {r.label: r["count"] for r in automl.balanced(train).groupBy("label").count().collect()}
    assert counts == {0: 90, 1: 90}
    assert automl.balanced(train).select("id").distinct().count() == 180


def test_classifying_documents_trains_every_model_of_the_registry(spark, monkeypatch):
    entry = models.Entry(lambda train, p: (_ for _ in ()).throw(ImportError("not here")))
    monkeypatch.setattr(automl, "CLASSIFIERS", {name: entry for name in models.CLASSIFIERS})
    df = table(spark, np.arange(20.0)[:, None], np.arange(20) % 2)
    monkeypatch.setattr(model_plans, "class_table", lambda *_: df)
    asked = {r["model"]: r["status"] for r in model_plans.classify_documents(spark, "").collect()}
    assert asked == {name: "unavailable" for name in models.CLASSIFIERS}


def test_a_model_that_fails_in_one_fold_has_no_score(linear, monkeypatch):
    _, _, df = linear
    good = models.REGRESSORS["linear_regression"]
    fits = []

    def broken(train, p):
        fits.append(train)
        if len(fits) == 2:
            raise ValueError("no fit")
        return good.fit(train, p)

    monkeypatch.setattr(automl, "REGRESSORS", {"good": good, "broken": models.Entry(broken)})
    rows = {r["model"]: r for r in automl.automl(df, False, folds=3, parallel=1)[0].collect()}
    assert rows["good"]["status"] == "completed" and rows["good"]["score"] > 0.95 and rows["good"]["r2"] > 0.95
    assert rows["broken"]["status"] == "failed" and rows["broken"]["score"] is None


@pytest.mark.parametrize("held", [1000, 100])
def test_boosted_stumps_follow_their_weights(spark, monkeypatch, held):
    monkeypatch.setattr(models, "MOST_ROWS", held)
    x = np.random.default_rng(4).normal(size=(400, 2)).round(1)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    df = table(spark, x, y)
    trained = models.fit_adaboost_classifier(df, {"n_estimators": 12})
    hit = trained.score(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.max(F.abs(F.col("probability")[0] + F.col("probability")[1] - 1))).first()
    assert hit[0] > 0.9 and hit[1] < 1e-9
