"""Which kind of learning problem a table poses, by ordered rules over one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.cells import is_numeric, numeric_columns, pandas_dtype, parse_timestamp, string_columns
from tabloom.operators.profile import SERIES_NAME_PARTS, TIME_NAME_PARTS, distinct_counts, wide_stats
from tabloom.session import beside, values_frame

# Words in a goal that ask for a forecast.
FORECAST_TERMS = ["forecast", "future", "trend", "seasonal", "time series", "timeseries", "next"]
# Target name parts that hint at classes.
CLASS_NAME_PARTS = ["class", "category", "label", "type", "status", "segment", "churn",
                    "fraud", "approved", "default", "outcome", "result"]
# Algorithms per problem type; any other type gets the last entry.
ALGORITHMS = [
    ("binary_classification", ["logistic_regression", "random_forest", "xgboost"]),
    ("multiclass_classification", ["random_forest", "xgboost", "logistic_regression"]),
    ("regression", ["linear_regression", "random_forest", "xgboost"]),
    ("clustering", ["kmeans", "dbscan"]),
    ("timeseries", ["arima", "prophet", "lstm"]),
]
DEFAULT_ALGORITHMS = ["random_forest"]

HEAD = 100  # rows whose text is tried as dates


def _named(name: str, parts: list[str]) -> bool:
    return any(p in name.lower() for p in parts)


def _parses(field: T.StructField) -> Column:
    """Can this cell become a timestamp? Numbers, dates and NULL always can."""
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name).isNull() | parse_timestamp(F.col(field.name)).isNotNull()
    return F.lit(not isinstance(field.dataType, T.BooleanType))


def series_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """Date-named columns and whether their first rows all parse as dates."""
    fields = [f for f in df.schema.fields if _named(f.name, SERIES_NAME_PARTS)]
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, parses boolean")
    head = df.orderBy(*order).limit(HEAD)
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.bool_and(_parses(f)).alias("parses"))
                      for f in fields])
    return head.agg(cells.alias("s")).selectExpr("inline(s)")


def detect_data_type(df: DataFrame, order: list[str]) -> DataFrame:
    """`timeseries` if a date-named column parses on the first rows, else `tabular`."""
    hit = F.coalesce(F.bool_or("parses"), F.lit(False))
    return series_columns(df, order).agg(F.when(hit, "timeseries").otherwise("tabular").alias("data_type"))


def detect_datetime_column(df: DataFrame, order: list[str]) -> DataFrame:
    """The time column: by name, else by type, else the first whose first rows parse."""
    named = [c for c in df.columns if _named(c, TIME_NAME_PARTS)]
    one = df.sparkSession.range(1)
    if named:
        return one.select(F.lit(named[0]).alias("column"))
    head = df.orderBy(*order).limit(HEAD)
    tries = [F.when(F.bool_and(_parses(f)), F.lit(f.name)) for f in df.schema.fields]
    return head.agg(F.coalesce(*tries).alias("column"))


def select_by_type(df: DataFrame, target: str | None = None) -> DataFrame:
    """Each column with its kind (numeric, categorical, other) and whether its name is date-like."""
    rows = []
    for pos, f in enumerate(df.schema.fields):
        kind = ("numeric" if is_numeric(f.dataType)
                else "categorical" if isinstance(f.dataType, (T.StringType, T.BooleanType)) else "other")
        rows.append((pos, f.name, kind, _named(f.name, SERIES_NAME_PARTS)))
    types = values_frame(df.sparkSession, rows, "pos int, column string, kind string, datetime_like boolean")
    return types.join(F.broadcast(distinct_counts(df, df.columns)), "column")


def target_signals(df: DataFrame, target: str, order: list[str]) -> DataFrame:
    """One row of facts about the target that the rules need, all from one count per value."""
    field = df.schema[target]
    c = F.col(target)
    numeric, text = is_numeric(field.dataType), isinstance(field.dataType, T.StringType)
    x = F.col("v").cast("double") if numeric else None
    cut = F.floor(F.abs(x)) * F.signum(x) if numeric else None
    whole = F.bool_and(F.abs(x - cut) <= 1e-8 + 1e-5 * F.abs(cut)) if numeric else F.lit(False)
    values = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    facts = values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(whole, F.lit(False)).alias("integer_like"),
        F.count("*").alias("uniques"))
    if text:
        head = df.where(c.isNotNull()).orderBy(*order).limit(HEAD)
        rate = head.agg(F.coalesce(F.avg(parse_timestamp(c).isNotNull().cast("int")), F.lit(0.0)).alias("date_rate"))
    else:
        dated = isinstance(field.dataType, (T.TimestampType, T.DateType))
        rate = df.sparkSession.range(1).select(F.lit(1.0 if dated else 0.0).alias("date_rate"))
    return beside(facts, rate).select(
        "*", F.lit(numeric).alias("numeric"), F.lit(text).alias("text"),
        F.lit(isinstance(field.dataType, T.BooleanType)).alias("boolean"),
        F.lit(target.lower()).alias("name"))


def problem_rules(forecast: Column) -> Column:
    """(problem_type, confidence) struct from the columns of `target_signals`."""
    u, n, ratio = F.col("uniques"), F.col("n"), F.col("uniques") / F.col("n")
    name = F.col("name")
    id_name = (name == "id") | name.endswith("_id") | F.contains(name, F.lit("uuid")) | F.contains(
        name, F.lit("identifier"))
    hinted = reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in CLASS_NAME_PARTS])

    def verdict(kind: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("problem_type"), F.lit(confidence).alias("confidence"))

    many = F.least(F.lit(100.0), F.greatest(F.lit(20.0), n * 0.5))
    return (
        F.when(n == 0, verdict("unknown", 0.0))
        .when(forecast, verdict("timeseries", 0.9))
        .when(F.col("boolean"), verdict("binary_classification", 0.98))
        .when((ratio > 0.9) & id_name, verdict("classification", 0.45))
        .when(F.col("date_rate") >= 0.8, verdict("timeseries", 0.75))
        .when(u == 2, verdict("binary_classification", 0.95))
        .when((u <= 20) & ((ratio <= 0.2) | hinted), verdict("multiclass_classification", 0.9))
        .when(~F.col("numeric") & (u <= many), verdict("multiclass_classification", 0.75))
        .when(F.col("numeric") & F.col("integer_like") & (u <= 50) & (ratio <= 0.1),
              verdict("multiclass_classification", 0.75))
        .when(F.col("numeric"), verdict("regression", 0.9))
        .when(F.col("text") & (u <= 50), verdict("multiclass_classification", 0.7))
        .otherwise(verdict("regression", 0.5))
    )


def detect_problem_type(df: DataFrame, target: str | None, order: list[str], goal: str = "") -> DataFrame:
    """One row: target, problem_type, confidence."""
    one = df.sparkSession.range(1)
    if target is None:
        return one.select(F.lit(None).cast("string").alias("target"), F.lit("clustering").alias("problem_type"),
                          F.lit(0.8).alias("confidence"))
    if target not in df.columns:
        return one.select(F.lit(target).alias("target"), F.lit("unknown").alias("problem_type"),
                          F.lit(0.0).alias("confidence"))
    asks = any(t in goal.lower() for t in FORECAST_TERMS)
    signals = target_signals(df, target, order)
    if asks:
        kind = detect_data_type(df, order)
        signals = beside(signals, kind).withColumn("f", F.col("data_type") == "timeseries")
    else:
        signals = signals.withColumn("f", F.lit(False))
    verdict = problem_rules(F.col("f"))
    return signals.select(F.lit(target).alias("target"), verdict.alias("v")).select("target", "v.*")


def recommended_algorithms(problems: DataFrame, column: str = "problem_type") -> DataFrame:
    """Add the algorithm list of each row's problem type."""
    table = F.create_map(*[e for k, v in ALGORITHMS for e in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    fallback = F.array(*[F.lit(x) for x in DEFAULT_ALGORITHMS])
    return problems.withColumn(
        "algorithms", F.array_join(F.coalesce(F.try_element_at(table, F.col(column)), fallback), ","))


def preprocessing_suggestions(df: DataFrame) -> DataFrame:
    """(step, detail) rows: missing values, categorical columns, scaling, high cardinality."""
    stats = wide_stats(df)
    texts = string_columns(df)
    parts = [
        stats.agg(F.sum("missing_count").alias("m")).where("m > 0")
        .select(F.lit("handle_missing").alias("step"), F.col("m").cast("string").alias("detail")),
    ]
    if texts:
        parts.append(df.sparkSession.range(1).select(
            F.lit("encode_categorical").alias("step"), F.lit(",".join(texts)).alias("detail")))
        parts.append(distinct_counts(df, texts).where("unique_count > 50").select(
            F.lit("high_cardinality").alias("step"), F.col("column").alias("detail")))
    if numeric_columns(df):
        parts.append(stats.agg(F.max(F.col("max") - F.col("min")).alias("r")).where("r > 1000").select(
            F.lit("scale_numeric").alias("step"), F.lit("").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def arbitrate_problem_type(decisions: DataFrame) -> DataFrame:
    """Take the second opinion only if it is known, different and clearly surer.

    Columns: rule_type, rule_confidence, other_type, other_confidence, target_uniques.
    Adds `problem_type` and the model family it leads to.
    """
    use_other = (
        (F.col("other_type") != "unknown") & (F.col("other_type") != F.col("rule_type"))
        & (F.col("other_confidence") >= F.greatest(F.lit(0.85), F.col("rule_confidence") + 0.1)))
    chosen = decisions.withColumn(
        "problem_type", F.when(F.coalesce(use_other, F.lit(False)), F.col("other_type")).otherwise(F.col("rule_type")))
    family = (
        F.when(F.contains("problem_type", F.lit("classification")), "classification")
        .when(F.col("problem_type") == "regression", "regression")
        .otherwise(F.when(F.col("target_uniques") <= 20, "classification").otherwise("regression")))
    return chosen.withColumn("family", family)
