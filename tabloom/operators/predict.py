"""Applying a model to any number of rows, in batch or on a stream.

Everything here is a projection (or a join with a checked small table), so the same
functions take a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.cells import round_exact
from tabloom.functions.ordering import row_positions
from tabloom.operators.models import Trained
from tabloom.operators.prep import category_dictionary, ordinal_encode
from tabloom.session import maybe_broadcast

API_DIGITS, UI_DIGITS = 4, 2


def decode_prediction(prediction: Column, classes: list[str]) -> Column:
    """Class name of an index; an index outside the classes is shown as the number itself."""
    names = F.array(*[F.lit(c) for c in classes])
    index = prediction.cast("int")
    shown = F.when(prediction == F.floor(prediction), index.cast("string")).otherwise(prediction.cast("string"))
    return F.coalesce(F.when(index >= 0, F.try_element_at(names, index + 1)), shown)


def round_prediction(prediction: Column, digits: int = API_DIGITS) -> Column:
    """Rounded as Python rounds."""
    return round_exact(prediction, digits)


def confidence(probability: Column, digits: int = API_DIGITS) -> Column:
    return round_exact(F.array_max(probability), digits)


def confidence_percent(probability: Column) -> Column:
    return round_exact(F.array_max(probability) * 100, 1)


def class_probabilities(df: DataFrame, classes: list[str], probability: str = "probability") -> DataFrame:
    """Add `ranked`: (p, class) pairs, most likely first."""
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.zip_with(probability, names, lambda p, c: F.struct((-p).alias("k"), c.alias("class"), p.alias("p")))
    return df.withColumn("ranked", F.transform(F.array_sort(pairs), lambda s: F.struct(s["class"], s["p"])))


def batch_predict(trained: Trained, df: DataFrame, classes: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(row_index or id, prediction, confidence) for every row, without a row limit.

    `order` names the key whose order numbers the rows; a stream has no such order and
    keeps its id.
    """
    out = trained.score(df)
    conf = confidence(F.col("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    shown = decode_prediction(F.col("prediction"), classes) if classes else round_prediction(F.col("prediction"))
    res = out.select(F.col("id"), shown.alias("prediction"), conf.alias("confidence"))
    return row_positions(res, [], [order], "row_index") if order else res


def input_range_check(df: DataFrame, schema: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value, min, max) of the inputs outside the training range; `schema` has one row per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(key, F.explode(pairs).alias("s")).select(key, "s.*").where(F.col("value").isNotNull())
    limits = schema.select("column", "min", "max")
    return long.join(maybe_broadcast(limits), "column").where((F.col("value") < F.col("min")) | (F.col("value") > F.col("max")))


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes by sorted order inside this batch; NULL is -1."""
    return ordinal_encode(df, columns, category_dictionary(df, columns), unseen=-1)
