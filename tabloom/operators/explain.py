"""Why a model predicts what it does, as table jobs over (id, features) rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import hash_ranks
from tabloom.operators import evaluate
from tabloom.operators.forest import DeepForest
from tabloom.operators.models import Score, Trained
from tabloom.operators.treeshap import FEW_FEATURES, Trees, forest_shap, tree_shap
from tabloom.session import beside, checkpointed, values_frame

REPEATS = 10
# Sentence templates of a text explanation.
INTRO = "The prediction was primarily influenced by:"
LINE = "%d. **%s** (value: %.2f) %s the prediction by %.4f"


def tree_importance(trained: Trained, names: list[str], spark) -> DataFrame:
    """(feature, importance) of a tree model, largest first."""
    values = trained.model.featureImportances.toArray()
    return values_frame(spark, [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def permutation_importance(score: Score, df: DataFrame, names: list[str], classify: bool, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """(feature, importance, std): loss of accuracy or R2 when one feature's values are shuffled.

    A shuffle pairs the rows ranked by one hash with the rows ranked by another, so no
    task orders the whole table; all features and repeats are scored in one pass.
    """
    base = df.select("id", "label", vector_to_array("features").alias("x"))
    ranked = checkpointed(hash_ranks(base.withColumn("__h", F.md5(F.col("id").cast("string"))), [], "__h", "place").drop("__h"))
    shuffled = None
    for r in range(repeats):
        h = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(f"{seed}-{r}")))
        donors = hash_ranks(ranked.select("id", F.col("x").alias("other"), h.alias("__h")), [], "__h", "place").select("place", "other")
        part = ranked.join(donors, "place").withColumn("repeat", F.lit(r))
        shuffled = part if shuffled is None else shuffled.unionByName(part)
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.element_at(F.col("other"), (i + 1).cast("int"))).otherwise(v))
    rows = shuffled.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).withColumn("features", array_to_vector(swapped))
    metric = "accuracy" if classify else "r2"
    fn = evaluate.classification_metrics if classify else evaluate.regression_metrics
    # ids must be distinct for models that join on them
    scored = score(rows.select(F.xxhash64("id", "j", "repeat").alias("id"), "label", "features", "j", "repeat"))
    parts = fn(scored.select("j", "repeat", F.col("label").alias("y"), F.col("prediction").alias("yhat")), ["j", "repeat"])
    whole = fn(score(df).select(F.col("label").alias("y"), F.col("prediction").alias("yhat"))).select(F.col(metric).alias("whole"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    loss = F.col("whole") - F.col(metric)
    return beside(parts, whole).groupBy(label.alias("feature")).agg(F.avg(loss).alias("importance"), F.stddev_pop(loss).alias("std"))


def shap_linear(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(id, feature, value, shap_value): coefficient times the distance from the mean."""
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in coefficients])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                               (F.lit(k) * (F.col(c) - F.col(f"__m_{c}"))).alias("shap_value")) for c, k in coefficients.items()])
    return beside(df, means).select("id", F.explode(cells).alias("s")).select("id", "s.*")


def shap_sampled(score: Score, output: Column, df: DataFrame, names: list[str], permutations: int = 16, seed: int = 42,
                 background: int | None = None) -> DataFrame:
    """(id, feature, value, shap_value) for any model, by permutation sampling.

    For each row and permutation another row of the table, drawn by hash from all of them (or from the first `background`
    in hash order), is turned into the row one feature at a time; the change of the output belongs to that feature. The values of a row add up to its output minus
    the mean output of the rows it was compared with.
    """
    d = len(names)
    rows = df.select("id", vector_to_array("features").alias("x"))
    placed = checkpointed(hash_ranks(rows.withColumn("__h", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(seed)))), [], "__h", "place").drop("__h"))
    held = placed.count()
    count = F.lit(held if background is None else max(1, min(background, held)))
    one = placed.drop("place").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    pick = F.pmod(F.xxhash64("id", "perm", F.lit(seed + 1)), count)
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(
        F.xxhash64("id", "perm", i, F.lit(seed)).alias("h"), i.alias("i")))), lambda s: s["i"])
    one = one.withColumns({"pick": pick, "order": order}).join(placed.select(F.col("place").alias("pick"), F.col("x").alias("b")), "pick")
    steps = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = F.transform("x", lambda v, i: F.when(
        F.array_position(F.slice("order", 1, F.col("k")), i.cast("int")) > 0, v).otherwise(F.element_at(F.col("b"), (i + 1).cast("int"))))
    keyed = steps.select(F.xxhash64("id", "perm", "k").alias("key"), F.col("id").alias("row"), "perm", "k", "order", "x",
                         array_to_vector(mixed).alias("features")).withColumnRenamed("key", "id")
    out = score(keyed).select("row", "perm", "k", "order", "x", output.alias("f"))
    w = Window.partitionBy("row", "perm").orderBy("k")
    moved = out.withColumn("gain", F.col("f") - F.lag("f").over(w)).where(F.col("k") > 0)
    moved = moved.withColumn("j", F.element_at("order", F.col("k")))
    value = F.element_at(F.first("x"), F.col("j") + 1)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return moved.groupBy(F.col("row").alias("id"), "j").agg(value.alias("value"), F.avg("gain").alias("shap_value")).select(
        "id", label.alias("feature"), "value", "shap_value")


def shap_values(trained: Trained, df: DataFrame, names: list[str], output: Column, which: int | None = None) -> DataFrame:
    """Exact contributions for tree models, sampled ones for all others.

    Of a classifier's outputs `which` is explained: by default class 1 of two, and class 0 of more.
    """
    if not hasattr(trained.model, "featureImportances"):
        return shap_sampled(trained.score, output, df, names)
    if isinstance(trained.model, DeepForest) and len(trained.model.cuts) <= FEW_FEATURES:
        return forest_shap(df, trained.model, names, int(trained.model.classes == 2) if which is None else which)
    trees = Trees.of(trained.model, df.sparkSession)
    return tree_shap(df, trees, names, int(len(trees.expected) == 2) if which is None else which)


def global_importance(phi: DataFrame) -> DataFrame:
    """(feature, importance, importance_normalized, rank) from the mean absolute contributions."""
    mean = phi.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("importance"))
    everything = Window.partitionBy(F.lit(0))  # one row per feature
    total = F.sum("importance").over(everything)
    return mean.withColumn(
        "importance_normalized", F.when(total > 0, F.col("importance") / total).otherwise(F.col("importance"))).withColumn(
        "rank", F.row_number().over(everything.orderBy(F.desc("importance"), "feature")))


def explain_rows(phi: DataFrame) -> DataFrame:
    """Contributions per row, largest first, with sign, size and the row's sum."""
    w = Window.partitionBy("id")  # one row per feature of the row
    return phi.withColumns({
        "impact": F.when(F.col("shap_value") > 0, "positive").otherwise("negative"),
        "abs_impact": F.abs("shap_value"),
        "rank": F.row_number().over(w.orderBy(F.desc(F.abs("shap_value")), "feature")),
        "prediction_offset": F.sum("shap_value").over(w)})


def explanation_text(phi: DataFrame, k: int = 5) -> DataFrame:
    """(id, text): one sentence per row over its k strongest features."""
    top = explain_rows(phi).where(F.col("rank") <= k)
    verb = F.when(F.col("shap_value") > 0, "increased").otherwise("decreased")
    line = F.format_string(LINE, "rank", "feature", "value", verb, "abs_impact")
    lines = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("l"))
    return lines.select("id", F.concat_ws("\n", F.lit(INTRO), F.transform("l", lambda s: s["t"])).alias("text"))


def predict_explain(trained: Trained, df: DataFrame, names: list[str], output: Column) -> DataFrame:
    """(id, prediction, feature, importance): the tree importances where the model has them, else |contribution|."""
    preds = trained.score(df).select("id", F.bround("prediction", 4).alias("prediction"))
    if hasattr(trained.model, "featureImportances"):
        table = tree_importance(trained, names, df.sparkSession)
        return preds.join(F.broadcast(table))  # one row per feature
    phi = shap_values(trained, df, names, output)
    return preds.join(phi.select("id", "feature", F.abs("shap_value").alias("importance")), "id")


def top_feature(explained: DataFrame) -> DataFrame:
    return explained.groupBy("id").agg(F.max_by("feature", F.struct("importance", "feature")).alias("top_feature"))

