"""Model scores as aggregates over (group..., y, yhat, score) tables.

`group` (for example a model or fold name) may be empty. Every metric starts with a
map-side aggregate; only counts per class pair or per distinct score go further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import MAX_ROWS, running_totals
from tabloom.session import beside


def confusion_matrix(df: DataFrame, group: list[str] = [], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.groupBy(*group, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_metrics(df: DataFrame, group: list[str] = [], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; 0/0 counts as 0."""
    cells = confusion_matrix(df, group, y, yhat)
    # each cell counts once for its true class and once for its predicted class
    sides = cells.select(*group, F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("yhat").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")))).alias("s")).select(*group, "s.*")
    per = sides.groupBy(*group, "c").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "hit")])
    p, r = _ratio(F.col("hit"), F.col("predicted")), _ratio(F.col("hit"), F.col("support"))
    f1 = _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted"))
    n = F.sum("support")
    return per.groupBy(*group).agg(
        (F.sum("hit") / n).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / n).alias("f1_weighted"),
        (F.sum(p * F.col("support")) / n).alias("precision_weighted"),
        (F.sum(r * F.col("support")) / n).alias("recall_weighted"))


def _score_totals(df: DataFrame, group: list[str], y: str, score: str, max_rows: int) -> DataFrame:
    """Per distinct score, high to low: positives and negatives here and so far."""
    counts = df.groupBy(*group, F.col(score).alias("score")).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("p"), F.sum((F.col(y) != 1).cast("bigint")).alias("n"))
    counts = counts.withColumn("__down", -F.col("score"))
    return running_totals(counts, group, ["__down"], {"tp": F.col("p"), "fp": F.col("n")}, max_rows).drop("__down")


def roc_auc(df: DataFrame, group: list[str] = [], y: str = "y", score: str = "score", max_rows: int = MAX_ROWS) -> DataFrame:
    """Area under the ROC curve of a 0/1 target; equal scores count half."""
    totals = _score_totals(df, group, y, score, max_rows)
    won = F.sum(F.col("n").cast("double") * (F.col("tp") - F.col("p") / 2))
    return totals.groupBy(*group).agg(F.try_divide(won, F.sum("p").cast("double") * F.sum("n")).alias("roc_auc"))


def roc_curve(df: DataFrame, group: list[str] = [], y: str = "y", score: str = "score", max_rows: int = MAX_ROWS) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    totals = _score_totals(df, group, y, score, max_rows)
    sizes = df.groupBy(*group).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("__P"),
                                   F.sum((F.col(y) != 1).cast("bigint")).alias("__N"))
    joined = totals.join(F.broadcast(sizes), group) if group else beside(totals, sizes)  # one row per model
    return joined.select(*group, F.col("score").alias("threshold"),
                         (F.col("fp") / F.col("__N")).alias("fpr"), (F.col("tp") / F.col("__P")).alias("tpr"))


def regression_metrics(df: DataFrame, group: list[str] = [], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """RMSE, MAE, R2 and MAPE from one aggregate."""
    err = F.col(y) - F.col(yhat)
    sse = F.sum(err * err)
    return df.groupBy(*group).agg(
        F.sqrt(sse / F.count(err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(sse, F.var_pop(y) * F.count(y))).alias("r2"),
        (F.avg(F.abs(err / (F.col(y) + F.lit(1e-8)))) * 100).alias("mape"))


def forecast_metrics(df: DataFrame, group: list[str] = [], y: str = "y", yhat: str = "yhat") -> DataFrame:
    err = F.col(y) - F.col(yhat)
    return df.groupBy(*group).agg(
        F.avg(err * err).alias("mse"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.abs(err / (F.col(y) + F.lit(1e-8)))) * 100).alias("mape"))


def residuals(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Residual per row and, on every row, the range of the diagonal."""
    ends = df.agg(F.least(F.min(y), F.min(yhat)).alias("line_from"), F.greatest(F.max(y), F.max(yhat)).alias("line_to"))
    return beside(df.withColumn("residual", F.col(y) - F.col(yhat)), ends)


def top_importances(df: DataFrame, group: list[str], k: int = 10) -> DataFrame:
    """The k most important features per group; the rank limit is applied map-side."""
    w = Window.partitionBy(*group).orderBy(F.desc("importance"), "feature")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cv_summary(df: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    return df.groupBy(*group).agg(
        F.avg(score).alias("cv_score_mean"), F.stddev_pop(score).alias("cv_score_std"), F.count(score).alias("folds"))
