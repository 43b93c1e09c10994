"""Model evaluation queries over predictions derived from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.cells import tidy
from tabloom.operators import evaluate
from tabloom.plans.frames import JOBS
from tabloom.plans.registry import Frame, query

_ROUND = 6
SCORED = Frame(
    "lineitem", "l_linestatus AS model", "l_returnflag AS y", "CASE WHEN l_discount > 0.06 THEN 'A' WHEN l_tax > 0.05 THEN 'N'"
    " WHEN l_quantity > 30 THEN l_returnflag ELSE 'R' END AS yhat")
BINARY = Frame(
    "lineitem", "l_linestatus AS model", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y",
    "round(l_discount * 5 + l_tax + CASE WHEN l_returnflag = 'R' THEN 0.05 ELSE 0.0 END, 4) AS score")
PREDICTED = Frame("lineitem", "l_returnflag AS model", "CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice END AS y",
                  "l_quantity * 2000 AS yhat")


@query("confusion_matrix", f"SELECT model, y, yhat, count(*) AS n FROM ({SCORED.sql}) GROUP BY ALL")
def confusion(spark, d):
    return evaluate.confusion_matrix(SCORED(spark, d), ["model"])


@query("classification_metrics", f"""WITH c AS (SELECT model, y, yhat, count(*) AS n FROM ({SCORED.sql}) GROUP BY ALL),
s AS (SELECT model, y AS k, sum(n) AS support, sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS hit FROM c GROUP BY 1, 2),
p AS (SELECT model, yhat AS k, sum(n) AS predicted FROM c GROUP BY 1, 2),
m AS (SELECT s.model, s.k, support, hit, coalesce(hit / predicted, 0) AS prec, hit / support AS rec,
 2 * hit / (support + coalesce(predicted, 0)) AS f1 FROM s LEFT JOIN p ON s.model = p.model AND s.k = p.k)
SELECT model, round(sum(hit) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
 round(sum(prec * support) / sum(support), 6) AS precision_weighted, round(sum(rec * support) / sum(support), 6) AS recall_weighted
FROM m GROUP BY 1""")
def class_scores(spark, d):
    out = evaluate.classification_metrics(SCORED(spark, d), ["model"])
    return out.withColumns({c: tidy(F.col(c)) for c in out.columns if c != "model"})


@query("roc_auc", f"""WITH t AS ({BINARY.sql}), s AS (SELECT model, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM t GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER (PARTITION BY model ORDER BY score DESC) AS tp FROM s)
SELECT model, round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6) AS roc_auc FROM c GROUP BY 1""")
def auc(spark, d):
    return evaluate.roc_auc(BINARY(spark, d), ["model"]).withColumn("roc_auc", tidy(F.col("roc_auc")))


@query("roc_curve", f"""WITH t AS ({BINARY.sql}), s AS (SELECT model, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM t GROUP BY 1, 2)
SELECT model, score AS threshold, round(sum(n) OVER w / sum(n) OVER (PARTITION BY model), 6) AS fpr,
 round(sum(p) OVER w / sum(p) OVER (PARTITION BY model), 6) AS tpr FROM s WINDOW w AS (PARTITION BY model ORDER BY score DESC)""")
def curve(spark, d):
    out = evaluate.roc_curve(BINARY(spark, d), ["model"])
    return out.withColumns({"fpr": tidy(F.col("fpr")), "tpr": tidy(F.col("tpr"))})


@query("regression_metrics", f"""SELECT model, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse, round(avg(abs(y - yhat)), 4) AS mae,
 round(1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(log10(avg(abs((y - yhat) / (y + 1e-8))) * 100), 6) AS log_mape
FROM ({PREDICTED.sql}) GROUP BY 1""")
def price_scores(spark, d):
    # targets of zero make the percentage error huge, so its logarithm is compared
    out = evaluate.regression_metrics(PREDICTED(spark, d), ["model"])
    return out.select("model", tidy(F.col("rmse"), 4).alias("rmse"), tidy(F.col("mae"), 4).alias("mae"),
                      tidy(F.col("r2")).alias("r2"), tidy(F.log10("mape")).alias("log_mape"))


@query("residuals", f"""WITH t AS ({PREDICTED.sql}) SELECT model, y, yhat, round(y - yhat, 4) AS residual,
 (SELECT least(min(y), min(yhat)) FROM t) AS line_from, (SELECT greatest(max(y), max(yhat)) FROM t) AS line_to FROM t""")
def price_residuals(spark, d):
    return evaluate.residuals(PREDICTED(spark, d)).withColumn("residual", tidy(F.col("residual"), 4))


@query("top_importances", f"""WITH t AS (SELECT model, CAST(feature_key AS VARCHAR) AS feature, sum(importance) AS importance FROM ({JOBS.sql}) GROUP BY 1, 2)
SELECT model, feature, round(importance, 6) AS importance, CAST(row_number() OVER (PARTITION BY model ORDER BY round(importance, 6) DESC, feature) AS INTEGER) AS rank
FROM t QUALIFY rank <= 10""")
def job_importances(spark, d):
    t = JOBS(spark, d).groupBy("model", F.col("feature_key").cast("string").alias("feature")).agg(
        tidy(F.sum("importance")).alias("importance"))
    return evaluate.top_importances(t, ["model"])


@query("cv_summary", f"""SELECT model, round(avg(score), 6) AS cv_score_mean, round(stddev_pop(score), 6) AS cv_score_std, count(score) AS folds
FROM ({JOBS.sql}) GROUP BY 1""")
def job_cv(spark, d):
    out = evaluate.cv_summary(JOBS(spark, d), ["model"])
    return out.withColumns({"cv_score_mean": tidy(F.col("cv_score_mean")), "cv_score_std": tidy(F.col("cv_score_std"))})


STEPS = Frame("events", "event_id", "event_type AS series", "ts", "value AS y")


@query("forecast_metrics", f"""WITH t AS (SELECT series, y, lag(y) OVER (PARTITION BY series ORDER BY ts, event_id) AS yhat FROM ({STEPS.sql}))
SELECT series, round(avg((y - yhat) ** 2), 6) AS mse, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse, round(avg(abs(y - yhat)), 6) AS mae,
 round(avg(abs((y - yhat) / (y + 1e-8))) * 100, 4) AS mape FROM t WHERE yhat IS NOT NULL GROUP BY 1""")
def naive_forecast(spark, d):
    from tabloom.functions.ordering import framed

    # one-step forecast by the last value
    t = framed(STEPS(spark, d), ["series"], ["ts", "event_id"], 1, 0, lambda w: {"yhat": F.lag("y").over(w)})
    out = evaluate.forecast_metrics(t.where(F.col("yhat").isNotNull()), ["series"])
    return out.select("series", *[tidy(F.col(c), 4 if c == "mape" else 6).alias(c) for c in ("mse", "rmse", "mae", "mape")])
