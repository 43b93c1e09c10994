"""Short text lines computed from profile aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.cells import is_numeric, numeric_columns
from tabloom.operators.profile import distinct_counts, target_correlations
from tabloom.session import beside

# Line templates of the data insight list.
EXAMPLES_LINE = "Your data contains %s examples to learn from."
FACTORS_LINE = "Found %d different factors that might influence predictions."
CATEGORIES_LINE = "The model will learn to predict %d different categories."
NUMERIC_LINE = "The model will learn to predict numeric values for %s."
KEY_FACTORS_LINE = "Key factors that may influence predictions: %s"
# Line templates about a model.
WINNER_LINE = "%s achieved highest accuracy at %.1f%%"
TOP_FEATURE_LINE = "Model identified %s as most important (importance: %.2f)"
# Reasons by size of the data.
SIZE_REASONS = [(1000, "Trained on a substantial dataset"), (500, "Trained on a moderate dataset")]
SMALL_REASON = "Limited training data available"


def dataset_insights(df: DataFrame, target: str) -> DataFrame:
    """(line_no, line): size, features, target kind, strongest features."""
    size = df.agg(F.count(F.lit(1)).alias("n"))
    uniques = distinct_counts(df, [target]).select("unique_count")
    number = is_numeric(df.schema[target].dataType)
    few = F.col("unique_count") < 20 if number else F.lit(True)
    lines = [
        F.format_string(EXAMPLES_LINE, F.format_number("n", 0)),
        F.lit(FACTORS_LINE % (len(df.columns) - 1)),
        F.when(few, F.format_string(CATEGORIES_LINE, "unique_count")).otherwise(F.lit(NUMERIC_LINE % target)),
    ]
    base = beside(size, uniques)
    if number and len(numeric_columns(df)) > 1:
        top = target_correlations(df, target).where(F.col("rank") <= 3)
        names = top.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("feature").alias("a")))).alias("t"))
        base = beside(base, names)
        lines.append(F.when(F.size("t") > 0, F.format_string(
            KEY_FACTORS_LINE, F.array_join(F.transform("t", lambda x: x["a"]), ", "))))
    return base.select(F.posexplode(F.array(*lines)).alias("line_no", "line")).where(F.col("line").isNotNull())


def model_insights(scores: DataFrame, importances: DataFrame) -> DataFrame:
    """(experiment, kind, line): the winner and its most important feature.

    scores: (experiment, model, score); importances: (experiment, feature, importance).
    """
    best = scores.groupBy("experiment").agg(
        F.max_by("model", F.struct("score", "model")).alias("m"), F.max("score").alias("s"))
    top = importances.groupBy("experiment").agg(
        F.max_by("feature", F.struct("importance", "feature")).alias("f"), F.max("importance").alias("i"))
    winner = best.select("experiment", F.lit("winner").alias("kind"),
                         F.format_string(WINNER_LINE, "m", F.col("s") * 100).alias("line"))
    return winner.unionByName(top.select(
        "experiment", F.lit("top_feature").alias("kind"), F.format_string(TOP_FEATURE_LINE, "f", "i").alias("line")))


def size_reason(rows: Column) -> Column:
    out = F.when(rows >= SIZE_REASONS[0][0], SIZE_REASONS[0][1])
    for limit, text in SIZE_REASONS[1:]:
        out = out.when(rows >= limit, text)
    return out.otherwise(SMALL_REASON)


def trust_summary(sizes: DataFrame) -> DataFrame:
    """Train and test share and the size band of (data_size, train_size, test_size) rows."""
    share = lambda c: F.concat(F.bround(F.col(c) / F.col("data_size") * 100, 0).cast("int").cast("string"), F.lit("%"))
    return sizes.withColumns({
        "train_ratio": share("train_size"), "test_ratio": share("test_size"),
        "confidence": F.when(F.col("data_size") >= 1000, "high").otherwise("medium"),
        "size_reason": size_reason(F.col("data_size"))})
