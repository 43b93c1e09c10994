"""Model registry: every entry trains on (id, features, label) and scores DataFrames.

`features` is an ML vector, `label` a double (class index or target). A trained model
is a function that adds `prediction` and, for classes, `probability` (array<double>).
Where Spark ML has no such model the entry is an approximation and says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators import forest
from tabloom.operators.neighbors import knn_join
from tabloom.session import checkpointed, training_tasks

Score = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame, dict], "Trained"]
MAX_DEPTH = 30  # deepest tree Spark ML grows
SEED = 42


@dataclass
class Trained:
    """A fitted model: `score` adds the prediction; `model` is the Spark ML model where there is one."""

    score: Score
    model: object = None


@dataclass
class Entry:
    fit: Fit
    params: dict = field(default_factory=dict)


ROWS_PER_TASK = 20_000  # below this a training task is shorter than its scheduling
MOST_ROWS = 200_000  # rows of a task once every core has a few tasks: more tasks add only scheduling


def packed(train: DataFrame) -> DataFrame:
    """Persisted training rows in as many partitions as their number justifies.

    Iterative training runs hundreds of short jobs over the same rows. A table of a few
    numbers per row arrives in very few partitions, for it is small in bytes; its rows are
    dealt by id, a task per `ROWS_PER_TASK` rows, until every core has a few tasks; from there tasks
    grow to `MOST_ROWS` rows, since each of the hundreds of jobs schedules all of them.
    """
    return train.repartition(training_tasks(train.sparkSession, train.count(), ROWS_PER_TASK, MOST_ROWS), "id").persist()


def facts(train: DataFrame) -> tuple[int, float, int]:
    """Rows, population std of the label, classes if labels are class indices."""
    row = train.agg(F.count("*"), F.stddev_pop("label"), F.max("label")).first()
    return row[0], row[1] or 1.0, int(row[2] or 0) + 1


def _spark_ml(model, keep_probability: bool = True) -> Trained:
    extra = [c for c in ("rawPrediction",)]

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.drop(*extra)

    return Trained(score, model)


def _binary_or_each(estimator, classes: int):
    """The binary estimator itself, or one model per class."""
    return estimator if classes <= 2 else OneVsRest(classifier=estimator, parallelism=4)


def _depth(p: dict) -> int:
    return min(int(p.get("max_depth") or MAX_DEPTH), MAX_DEPTH)


# ---- classification ----

def fit_logistic(train: DataFrame, p: dict) -> Trained:
    n = facts(train)[0]
    return _spark_ml(LogisticRegression(maxIter=p["max_iter"], regParam=1.0 / n, standardization=False).fit(train))


def _forest(train: DataFrame, p: dict, classes: int, tried: int, cuts: list, bootstrap: bool = True) -> Trained:
    model = forest.fit_forest(train, p["n_estimators"], _depth(p), classes, tried, SEED, cuts, bootstrap)
    return Trained(model.transform, model)


def fit_forest_classifier(train: DataFrame, p: dict) -> Trained:
    cuts = forest.feature_cuts(train)
    return _forest(train, p, max(facts(train)[2], 2), math.ceil(math.sqrt(len(cuts))), cuts)


def fit_boosting_classifier(train: DataFrame, p: dict) -> Trained:
    est = GBTClassifier(maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=0.1, seed=SEED)
    return _spark_ml(_binary_or_each(est, facts(train)[2]).fit(train))


def fit_tree_classifier(train: DataFrame, p: dict) -> Trained:
    return _spark_ml(DecisionTreeClassifier(maxDepth=_depth(p), seed=SEED).fit(train))


def random_fourier(train: DataFrame, size: int = 256) -> Score:
    """Feature map whose inner products approximate the RBF kernel with the scale-free width
    1 / (features x variance), after Rahimi and Recht."""
    x = vector_to_array("features")
    long = train.select(F.explode(x).alias("x"))
    var = long.agg(F.var_pop("x")).first()[0] or 1.0
    d = len(train.select(x.alias("x")).first()["x"])
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, math.sqrt(2.0 / (d * var)), (d, size))
    b = rng.uniform(0, 2 * math.pi, size)

    @F.pandas_udf("array<double>")
    def waves(v: pd.Series) -> pd.Series:
        rows = np.array(v.tolist(), dtype=float).reshape(len(v), d)
        return pd.Series(list(math.sqrt(2.0 / size) * np.cos(rows @ w + b)))

    return lambda df: df.withColumn("features", array_to_vector(waves(vector_to_array("features"))))


def fit_kernel_svm(train: DataFrame, p: dict) -> Trained:
    """Approximation of an RBF support vector machine: random Fourier features and a linear one."""
    n, _, classes = facts(train)
    lift = random_fourier(train)
    lifted = lift(packed(train)).persist()
    est = LinearSVC(maxIter=100, regParam=1.0 / n, standardization=False)
    model = _binary_or_each(est, classes).fit(lifted)
    lifted.unpersist()

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(lift(df.withColumn("__f", F.col("features"))))
        if classes <= 2:
            margin = vector_to_array("rawPrediction")[1]
            up = 1 / (1 + F.exp(-margin))
            out = out.withColumn("probability", F.array(1 - up, up))
        return out.withColumn("features", F.col("__f")).drop("__f", "rawPrediction")

    return Trained(score, model)


def _neighbour_votes(df: DataFrame, train: DataFrame, k: int) -> DataFrame:
    q = df.select(F.col("id").cast("bigint").alias("id"), vector_to_array("features").alias("v"))
    p = train.select(F.col("id").cast("bigint").alias("id"), vector_to_array("features").alias("v"))
    near = knn_join(q, p, k)
    return near.join(train.select(F.col("id").alias("pid"), "label"), "pid")


def fit_knn_classifier(train: DataFrame, p: dict) -> Trained:
    """Exact neighbours; an even vote goes to the smallest class."""
    k, classes = p["n_neighbors"], facts(train)[2]

    def score(df: DataFrame) -> DataFrame:
        votes = _neighbour_votes(df, train, k).groupBy(F.col("qid").alias("id")).agg(
            *[F.count_if(F.col("label") == c).alias(f"c{c}") for c in range(classes)])
        counts = F.array(*[F.col(f"c{c}") for c in range(classes)])
        total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, v: a + v)
        voted = votes.select("id", (F.array_position(counts, F.array_max(counts)) - 1).cast("double").alias("prediction"),
                             F.transform(counts, lambda v: v / total).alias("probability"))
        return df.join(voted, "id")

    return Trained(score)


def _next_weights(rows: DataFrame, scored: DataFrame, weight: Column, r: int) -> DataFrame:
    """Reweighted rows, kept in memory and every ten rounds written out to end their lineage."""
    new = scored.select("id", "features", "label", weight.alias("w"))
    new = checkpointed(new) if r % 10 == 9 else new.persist()
    new.count()
    rows.unpersist()
    return new


STUMP_BINS = 32


def fit_adaboost_classifier(train: DataFrame, p: dict) -> Trained:
    """SAMME over one-split trees.

    Features are cut into bins once, and rows packed into blocks of bytes. A round is one pass: tasks
    follow the weights through the stumps so far and send back the class weights per bin, from which
    the driver reads the best split, its error and its vote.
    """
    n, _, classes = facts(train)
    classes = max(classes, 2)
    x = vector_to_array("features")
    d = len(train.select(x.alias("x")).first()["x"])
    shares = F.array(*[F.lit(i / STUMP_BINS) for i in range(1, STUMP_BINS)])
    got = train.select(x.alias("x")).agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000) for i in range(d)]).first()
    cuts = [np.array(sorted(set(c))) for c in got]
    cell = forest.cells_of(cuts)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cells": [b"".join(b["c"])], "y": [b["y"].to_numpy(dtype=float).tobytes()]})

    held = packed(train.select("id", "features", "label"))
    blocks = held.select(cell(vector_to_array("features")).alias("c"), F.col("label").cast("double").alias("y")).mapInPandas(
        block, "cells binary, y binary").persist()
    stumps: list[tuple[int, int, int, int, float]] = []
    steps: list[tuple[int, int, int, int, float, float]] = []  # the stumps with the factor and divisor of their reweighting

    def reweighted(cells: np.ndarray, y: np.ndarray, w: np.ndarray, since: list) -> None:
        for f, cut, left, right, factor, total in since:
            w *= np.where(np.where(cells[:, f] <= cut, left, right) != y, factor, 1.0) / total

    def summed(cells: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(cells[:, f] * np.int64(classes) + y, w, STUMP_BINS * classes).reshape(STUMP_BINS, classes) for f in range(d)])

    def arrays(cells: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        labels = np.frombuffer(y).astype(int)
        return np.frombuffer(cells, np.uint8).reshape(-1, d), labels, np.ones(len(labels))

    def weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((d, STUMP_BINS, classes))
        for b in batches:
            for part in map(arrays, b["cells"], b["y"]):
                reweighted(*part, steps)
                table += summed(*part)
        yield pd.DataFrame({"t": [table.tobytes()]})

    # a byte per value: so few rows are summed faster than a pass over them is scheduled
    here = [arrays(r["cells"], r["y"]) for r in blocks.collect()] if n <= MOST_ROWS else None
    for _ in range(p["n_estimators"]):
        if here is None:
            parts = blocks.mapInPandas(weighted, "t binary").collect()  # features x bins x classes numbers a task
            table = sum(np.frombuffer(r["t"]).reshape(d, STUMP_BINS, classes) for r in parts)
        else:
            for part in here:
                reweighted(*part, steps[-1:])
            table = sum(summed(*part) for part in here)
        total = table[0].sum()
        f, cut, left, right, hit = _best_split(table)
        error = 1 - hit / total
        if error <= 1e-12:
            stumps.append((f, cut, left, right, 1.0))
            break
        if error >= 1 - 1 / classes:
            break
        alpha = math.log((1 - error) / error) + math.log(classes - 1)
        stumps.append((f, cut, left, right, alpha))
        steps.append((f, cut, left, right, math.exp(alpha), total))
    blocks.unpersist()
    held.unpersist()
    if not stumps:
        raise ValueError("the first stump is no better than chance")

    @F.pandas_udf("array<double>")
    def votes(c: pd.Series) -> pd.Series:
        cells = np.frombuffer(b"".join(c), np.uint8).reshape(-1, d)
        out = np.zeros((len(cells), classes))
        for f, cut, left, right, alpha in stumps:
            out[np.arange(len(cells)), np.where(cells[:, f] <= cut, left, right)] += alpha
        return pd.Series(list(out), dtype=object)

    def score(df: DataFrame) -> DataFrame:
        out = df.withColumn("__v", votes(cell(vector_to_array("features"))))
        total = sum(t[4] for t in stumps)
        return out.withColumn("prediction", (F.array_position("__v", F.array_max("__v")) - 1).cast("double")).withColumn(
            "probability", F.transform("__v", lambda v: v / total)).drop("__v")

    return Trained(score)


def _best_split(table: np.ndarray) -> tuple[int, int, int, int, float]:
    """(feature, bin, left class, right class, weight predicted right) with the lowest Gini impurity."""
    left = table.cumsum(axis=1)
    right = table.sum(axis=1, keepdims=True) - left
    purity = sum((s ** 2).sum(axis=2) / np.maximum(s.sum(axis=2), 1e-300) for s in (left, right))
    f, cut = np.unravel_index(purity.argmax(), purity.shape)
    a, b = left[f, cut], right[f, cut]
    return int(f), int(cut), int(a.argmax()), int(b.argmax()) if b.sum() > 0 else int(a.argmax()), float(a.max() + b.max())


def fit_extra_trees_classifier(train: DataFrame, p: dict) -> Trained:
    """Approximation of extremely random trees: unsampled trees over random cut points."""
    cuts = forest.random_cuts(train, SEED)
    return _forest(train, p, max(facts(train)[2], 2), math.ceil(math.sqrt(len(cuts))), cuts, bootstrap=False)


# ---- regression ----

def fit_linear(train: DataFrame, p: dict) -> Trained:
    return _spark_ml(LinearRegression(solver="normal").fit(train))


def fit_ridge(train: DataFrame, p: dict) -> Trained:
    n, s, _ = facts(train)
    return _spark_ml(LinearRegression(elasticNetParam=0.0, standardization=False, regParam=p["alpha"] * s / n, solver="normal").fit(train))


def fit_lasso(train: DataFrame, p: dict) -> Trained:
    return _spark_ml(LinearRegression(elasticNetParam=1.0, standardization=False, regParam=p["alpha"], maxIter=p["max_iter"], tol=1e-9).fit(train))


def fit_elasticnet(train: DataFrame, p: dict) -> Trained:
    s = facts(train)[1]
    reg = p["alpha"] * (p["l1_ratio"] + (1 - p["l1_ratio"]) * s)
    return _spark_ml(LinearRegression(elasticNetParam=p["alpha"] * p["l1_ratio"] / reg, standardization=False, regParam=reg,
                                      maxIter=p["max_iter"], tol=1e-9).fit(train))


def fit_forest_regressor(train: DataFrame, p: dict) -> Trained:
    cuts = forest.feature_cuts(train)
    return _forest(train, p, 0, len(cuts), cuts)


def fit_boosting_regressor(train: DataFrame, p: dict) -> Trained:
    return _spark_ml(GBTRegressor(maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=0.1, seed=SEED).fit(train))


def fit_tree_regressor(train: DataFrame, p: dict) -> Trained:
    return _spark_ml(DecisionTreeRegressor(maxDepth=_depth(p), seed=SEED).fit(train))


def fit_kernel_svr(train: DataFrame, p: dict) -> Trained:
    """Approximation of RBF support vector regression: random Fourier features and a Huber loss."""
    n = facts(train)[0]
    lift = random_fourier(train)
    model = LinearRegression(loss="huber", regParam=1.0 / n, maxIter=100).fit(lift(train))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(lift(df.withColumn("__f", F.col("features"))))
        return out.withColumn("features", F.col("__f")).drop("__f")

    return Trained(score, model)


def fit_knn_regressor(train: DataFrame, p: dict) -> Trained:
    def score(df: DataFrame) -> DataFrame:
        mean = _neighbour_votes(df, train, p["n_neighbors"]).groupBy(F.col("qid").alias("id")).agg(F.avg("label").alias("prediction"))
        return df.join(mean, "id")

    return Trained(score)


def fit_adaboost_regressor(train: DataFrame, p: dict) -> Trained:
    """AdaBoost.R2 with linear loss; trees of depth three see row weights instead of resampled rows."""
    rows = packed(train.select("id", "features", "label").withColumn("w", F.lit(1.0)))
    trees: list[tuple[object, float]] = []
    for r in range(p["n_estimators"]):
        model = DecisionTreeRegressor(maxDepth=3, weightCol="w", seed=SEED + r).fit(rows)
        scored = model.transform(rows).withColumn("e", F.abs(F.col("prediction") - F.col("label")))
        worst, total, weighted = scored.agg(F.max("e"), F.sum("w"), F.sum(F.col("w") * F.col("e"))).first()
        if not worst:
            trees.append((model, 1.0))
            break
        loss = weighted / total / worst
        if loss >= 0.5:
            if not trees:
                trees.append((model, 1.0))
            break
        beta = loss / (1 - loss)
        trees.append((model, math.log(1 / beta)))
        rows = _next_weights(rows, scored, F.col("w") / total * F.pow(F.lit(beta), 1 - F.col("e") / worst), r)

    def score(df: DataFrame) -> DataFrame:
        out = df
        for i, (m, _) in enumerate(trees):
            out = m.transform(out).withColumnRenamed("prediction", f"__p{i}")
        both = F.array_sort(F.array(*[F.struct(F.col(f"__p{i}").alias("x"), F.lit(a).alias("a")) for i, (_, a) in enumerate(trees)]))
        out = out.withColumn("__v", both).drop(*[f"__p{i}" for i in range(len(trees))])
        return out.withColumn("prediction", weighted_median(F.col("__v"), sum(a for _, a in trees))).drop("__v")

    return Trained(score)


def weighted_median(pairs: Column, total: float) -> Column:
    """First value whose running weight reaches half of the total; pairs are sorted (x, a) structs."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("x"))
    step = lambda s, v: F.struct(
        (s["sum"] + v["a"]).alias("sum"),
        F.when(s["x"].isNull() & (s["sum"] + v["a"] >= total / 2), v["x"]).otherwise(s["x"]).alias("x"))
    return F.aggregate(pairs, start, step, lambda s: s["x"])


def fit_extra_trees_regressor(train: DataFrame, p: dict) -> Trained:
    """Approximation of extremely random trees: unsampled trees over random cut points."""
    cuts = forest.random_cuts(train, SEED)
    return _forest(train, p, 0, math.ceil(len(cuts) / 3), cuts, bootstrap=False)


def _external(module: str, name: str) -> Fit:
    """A boosted-tree package's Spark estimator; importing it fails where it is not installed."""

    def fit(train: DataFrame, p: dict) -> Trained:
        import importlib

        estimator = getattr(importlib.import_module(module), name)(n_estimators=p["n_estimators"])
        return _spark_ml(estimator.fit(train))

    return fit


CLASSIFIERS: dict[str, Entry] = {
    "logistic_regression": Entry(fit_logistic, {"max_iter": 1000}),
    "random_forest": Entry(fit_forest_classifier, {"n_estimators": 100}),
    "gradient_boosting": Entry(fit_boosting_classifier, {"n_estimators": 100, "max_depth": 5}),
    "svm": Entry(fit_kernel_svm),
    "knn": Entry(fit_knn_classifier, {"n_neighbors": 5}),
    "decision_tree": Entry(fit_tree_classifier, {"max_depth": 10}),
    "adaboost": Entry(fit_adaboost_classifier, {"n_estimators": 100}),
    "extra_trees": Entry(fit_extra_trees_classifier, {"n_estimators": 100}),
    "xgboost": Entry(_external("xgboost.spark", "SparkXGBClassifier"), {"n_estimators": 100}),
    "lightgbm": Entry(_external("synapse.ml.lightgbm", "LightGBMClassifier"), {"n_estimators": 100}),
}
REGRESSORS: dict[str, Entry] = {
    "linear_regression": Entry(fit_linear),
    "ridge": Entry(fit_ridge, {"alpha": 1.0}),
    "lasso": Entry(fit_lasso, {"alpha": 1.0, "max_iter": 2000}),
    "elasticnet": Entry(fit_elasticnet, {"alpha": 1.0, "l1_ratio": 0.5, "max_iter": 2000}),
    "random_forest": Entry(fit_forest_regressor, {"n_estimators": 100}),
    "gradient_boosting": Entry(fit_boosting_regressor, {"n_estimators": 100, "max_depth": 5}),
    "svr": Entry(fit_kernel_svr),
    "knn": Entry(fit_knn_regressor, {"n_neighbors": 5}),
    "decision_tree": Entry(fit_tree_regressor, {"max_depth": 10}),
    "adaboost": Entry(fit_adaboost_regressor, {"n_estimators": 100}),
    "extra_trees": Entry(fit_extra_trees_regressor, {"n_estimators": 100}),
    "xgboost": Entry(_external("xgboost.spark", "SparkXGBRegressor"), {"n_estimators": 100}),
    "lightgbm": Entry(_external("synapse.ml.lightgbm", "LightGBMRegressor"), {"n_estimators": 100}),
}

# Allowed range of each setting.
LIMITS = {"epochs": (1, 1000), "batch_size": (1, 1024), "learning_rate": (0, 1), "n_estimators": (1, 5000), "max_depth": (1, 100)}


def check_config(config: dict) -> list[str]:
    """Names of settings that are out of range or of the wrong type."""
    bad = []
    for name, (lo, hi) in LIMITS.items():
        v = config.get(name)
        if v is None:
            continue
        whole = name != "learning_rate"
        typed = isinstance(v, int) if whole else isinstance(v, (int, float))
        if isinstance(v, bool) or not typed or v > hi or (v < lo if whole else v <= lo):
            bad.append(name)
    return bad


def with_config(entry: Entry, config: dict | None) -> dict:
    """A run's own copy of the parameters, with the settings the model has."""
    p = dict(entry.params)
    for setting, name in (("n_estimators", "n_estimators"), ("max_depth", "max_depth"), ("epochs", "max_iter")):
        if config and config.get(setting) and name in p:
            p[name] = int(config[setting])
    return p


# ---- embeddings ----

HIDDEN = 256  # width of the head's hidden layer


def fit_embedding_head(train: DataFrame, deep: bool = False, epochs: int = 100) -> Trained:
    """Classifier head over frozen embeddings: logistic, or one hidden layer."""
    n, _, classes = facts(train)
    if not deep:
        return _spark_ml(LogisticRegression(maxIter=epochs, regParam=1.0 / n, standardization=False).fit(train))
    dim = len(train.select(vector_to_array("features").alias("x")).first()["x"])
    net = MultilayerPerceptronClassifier(layers=[dim, HIDDEN, max(classes, 2)], maxIter=epochs, seed=SEED)
    return _spark_ml(net.fit(train))
