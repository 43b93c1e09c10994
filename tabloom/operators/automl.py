"""Train a registry, score it, rank it, combine the best."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators import evaluate, models, sampling
from tabloom.operators.models import CLASSIFIERS, REGRESSORS, Entry, Trained

PARALLEL = 4  # model fits submitted at once
TOP = 3

CLASS_METRICS = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "roc_auc"]
VALUE_METRICS = ["r2", "rmse", "mae", "mape"]


def prepare_split(df: DataFrame, classify: bool) -> DataFrame:
    """(id, features, label) with `part` by hash, stratified for classes."""
    if classify:
        return sampling.stratified_split(df, "label", ["id"])
    return sampling.train_test_split(df, ["id"])


def _predictions(trained: Trained, df: DataFrame, name: str) -> DataFrame:
    out = trained.score(df)
    p = F.col("probability")[1] if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(F.lit(name).alias("model"), "id", F.col("label").alias("y"), F.col("prediction").alias("yhat"), p.alias("score"))


def test_metrics(preds: DataFrame, classify: bool, binary: bool) -> DataFrame:
    """Metrics per model from one table of predictions."""
    if not classify:
        return evaluate.regression_metrics(preds, ["model"])
    out = evaluate.classification_metrics(preds, ["model"])
    if binary:
        auc = evaluate.roc_auc(preds.where(F.col("score").isNotNull()), ["model"])
        return out.join(F.broadcast(auc), "model", "left")  # one row per model
    return out.withColumn("roc_auc", F.lit(None).cast("double"))


def _run_all(spark, jobs: list, parallel: int) -> list:
    with ThreadPool(parallel) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda j: j()), jobs, 1)


def balanced(train: DataFrame) -> DataFrame:
    """(id, label, features) and made-up rows for the smaller classes; their ids are hashes of source and number."""
    first = train.select("features").first()
    if first is None:
        return train
    names = [f"f{i}" for i in range(len(first["features"]))]
    wide = train.select("id", "label", vector_to_array("features").alias("x")).select(
        "id", "label", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    made = sampling.smote(wide, "id", "label", names).where("copy > 0")
    return train.select("id", "label", "features").unionByName(made.select(
        F.xxhash64("source", "copy").alias("id"), F.col("label").cast(train.schema["label"].dataType).alias("label"),
        array_to_vector(F.array(*names)).alias("features")))


def automl(
    df: DataFrame, classify: bool, names: list[str] | None = None, folds: int | None = 5, config: dict | None = None,
    parallel: int = PARALLEL, balance: bool = False,
) -> tuple[DataFrame, dict[str, Trained]]:
    """Leaderboard and trained models.

    With `balance`, SMOTE brings every class of the training part to the size of the largest; the test part stays as it is.

    With `folds`, models are ranked by mean cross-validation score (accuracy or R2) on the
    training part; without, by the score on the test part. A model that fails becomes a row
    with status `failed`, one whose package is missing `unavailable`.
    """
    bad = models.check_config(config or {})
    if bad:
        raise ValueError(f"settings out of range: {', '.join(bad)}")
    registry = CLASSIFIERS if classify else REGRESSORS
    names = [n for n in (names or list(registry)) if n in registry]
    split = prepare_split(df, classify)
    train = split.where("part = 'train'").drop("part")
    if balance and classify:
        train = balanced(train)
    if folds:
        train = sampling.kfold_assign(train, ["id"], "label" if classify else None, folds)
    train, test = models.packed(train), split.where("part = 'test'").drop("part").persist()
    binary = classify and models.facts(train)[2] == 2
    metric = "accuracy" if classify else "r2"
    spark = df.sparkSession

    def one(name: str, fold: int | None) -> dict:
        """One fit: of a fold, its score on the fold; of the whole training part, the model and its test metrics."""
        entry: Entry = registry[name]
        try:
            params = models.with_config(entry, config)
            if fold is None:
                trained = entry.fit(train.drop("fold"), params)
                return {"trained": trained, "metrics": test_metrics(_predictions(trained, test, name), classify, binary).first().asDict()}
            fitted = entry.fit(train.where(F.col("fold") != fold).drop("fold"), params)
            p = _predictions(fitted, train.where(F.col("fold") == fold).drop("fold"), name)
            scored = (evaluate.classification_metrics if classify else evaluate.regression_metrics)(p, ["model"])
            return {"fold_scores": [r[metric] for r in scored.select(metric).collect()]}
        except ImportError as e:
            return {"status": "unavailable", "error": str(e).split("\n")[0]}
        except Exception as e:  # noqa: BLE001 - a failing model must not end the run
            return {"status": "failed", "error": str(e).split("\n")[0][:200]}

    # fits are submitted one by one, so that a slow model's folds do not wait for each other
    turns = [*range(folds or 0), None]
    done = _run_all(spark, [lambda n=n, k=k: one(n, k) for n in names for k in turns], parallel)
    rows = []
    for i, name in enumerate(names):
        fits = done[i * len(turns):(i + 1) * len(turns)]
        cut = next((f for f in fits[:-1] if "status" in f), None)
        row = {"model": name, "status": "completed", "error": None, "trained": None,
               "fold_scores": [s for f in fits[:-1] for s in f["fold_scores"]] if folds and not cut else None}
        rows.append(row | (cut or fits[-1]))
    table = _board(spark, rows, metric, CLASS_METRICS if classify else VALUE_METRICS, bool(folds))
    return table, {r["model"]: r["trained"] for r in rows if r["trained"] is not None}


def _board(spark, rows: list[dict], metric: str, columns: list[str], cv: bool) -> DataFrame:
    flat = []
    for pos, r in enumerate(rows):
        m = r.get("metrics") or {}
        flat.append((pos, r["model"], r["status"], r["error"], r["fold_scores"], *[m.get(c) for c in columns]))
    schema = "position int, model string, status string, error string, fold_scores array<double>, " + ", ".join(
        f"{c} double" for c in columns)
    df = spark.createDataFrame(flat, schema).coalesce(1)  # one row per model
    n = F.size("fold_scores")
    mean = F.aggregate("fold_scores", F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumn("cv_score_mean", mean)
    df = df.withColumn("cv_score_std", F.sqrt(F.aggregate(
        F.transform("fold_scores", lambda x: (x - F.col("cv_score_mean")) * (x - F.col("cv_score_mean"))), F.lit(0.0), lambda a, x: a + x) / n))
    df = df.withColumn("score", F.col("cv_score_mean") if cv else F.col(metric)).drop("fold_scores")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("score"), "position")  # one row per model
    return df.withColumn("rank", F.row_number().over(w)).withColumn("best", (F.col("rank") == 1) & F.col("score").isNotNull())


# ---- votes over (model, id, ...) tables ----

ROWS_OF_IDS = 100_000  # rows of the ids that one task aggregates


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """`df` of about `rows` rows dealt by key, so that a task aggregates about `ROWS_OF_IDS` of them whatever their number.

    Keys that repeat only a few times make an aggregate as large as its input; a fixed number of tasks would hold ever more.
    """
    return df.repartition(max(1, -(-rows // ROWS_OF_IDS)), key)


def vote_soft(probabilities: DataFrame) -> DataFrame:
    """(id, prediction, confidence): mean class probability over models, ties to the smallest class."""
    long = probabilities.select("id", F.posexplode("probability").alias("c", "p"))
    mean = long.groupBy("id", "c").agg(F.avg("p").alias("p"))
    return mean.groupBy("id").agg(
        F.max_by("c", F.struct("p", (-F.col("c")).alias("k"))).alias("prediction"), F.max("p").alias("confidence"))


def vote_hard(predictions: DataFrame) -> DataFrame:
    """(id, prediction): commonest class, ties to the smallest."""
    counts = predictions.groupBy("id", "prediction").agg(F.count("*").alias("n"))
    return counts.groupBy("id").agg(F.max_by("prediction", F.struct("n", (-F.col("prediction")).alias("k"))).alias("prediction"))


def vote_mean(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("id").agg(F.avg("prediction").alias("prediction"))


def ensemble_top3(df: DataFrame, classify: bool, board: DataFrame, trained: dict[str, Trained]) -> DataFrame:
    """(model, score, replaces_winner) of the vote of the three best models on the test part.

    Soft voting when every member gives probabilities, else hard; values are averaged.
    """
    ranked = [r for r in board.where("status = 'completed'").orderBy("rank").limit(TOP).collect()]
    if len(ranked) < 2:
        raise ValueError("an ensemble needs at least two models")
    metric = "accuracy" if classify else "r2"
    test = prepare_split(df, classify).where("part = 'test'").drop("part")
    parts, soft = None, True
    for r in ranked:
        out = trained[r["model"]].score(test)
        has = "probability" in out.columns
        soft = soft and has
        p = F.col("probability") if has else F.lit(None).cast("array<double>")
        out = out.select(F.lit(r["model"]).alias("model"), "id", "prediction", p.alias("probability"))
        parts = out if parts is None else parts.unionByName(out)
    if not classify:
        voted, how = vote_mean(parts), "mean"
    elif soft:
        voted, how = vote_soft(parts).select("id", F.col("prediction").cast("double").alias("prediction")), "soft"
    else:
        voted, how = vote_hard(parts), "hard"
    joined = voted.join(test.select("id", F.col("label").alias("y")), "id").withColumnRenamed("prediction", "yhat")
    scores = evaluate.classification_metrics(joined) if classify else evaluate.regression_metrics(joined)
    single = max(r[metric] for r in ranked)
    return scores.select(
        F.lit("+".join(r["model"] for r in ranked)).alias("members"), F.lit(how).alias("vote"), F.col(metric).alias("score"),
        F.lit(float(single)).alias("best_single"), (F.col(metric) > single).alias("replaces_winner"))
