"""Tabular preprocessing: fitting is aggregates, transforming is columnar expressions.

Scaler and imputer parameters are a few numbers per column and live in the driver.
Category dictionaries may be large, so they stay DataFrames and are joined.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.cells import is_numeric, nan_to_null
from tabloom.functions.ordering import row_positions
from tabloom.functions.quantiles import column_quantiles
from tabloom.operators.profile import distinct_counts, wide_stats
from tabloom.session import beside, maybe_broadcast, scratch, values_frame

HIGH_MISSING = 0.6
MAX_CLASS_NUMBERS = 10


def missing_ratios(df: DataFrame) -> DataFrame:
    return wide_stats(df).select("column", (F.col("missing_count") / F.col("rows")).alias("missing_ratio"))


def drop_high_missing(df: DataFrame, limit: float = HIGH_MISSING) -> DataFrame:
    """Drop the columns whose share of missing values is above `limit`."""
    drop = [r["column"] for r in missing_ratios(df).where(F.col("missing_ratio") > limit).collect()]
    return df.drop(*drop)


def identify_columns(df: DataFrame, max_numbers: int = MAX_CLASS_NUMBERS) -> DataFrame:
    """(column, kind): numbers are numeric unless they take few values in many rows."""
    # Number types considered; other types are categorical.
    numeric = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("bigint", "int", "double", "float")]
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    uniques = beside(distinct_counts(df, df.columns), rows)
    few = (F.col("unique_count") <= max_numbers) & (F.col("unique_count") < F.col("rows") * 0.05)
    return uniques.select(
        "column", "unique_count",
        F.when(F.col("column").isin(numeric) & ~few, "numeric").otherwise("categorical").alias("kind"))


def fit_fill(df: DataFrame, columns: list[str], strategy: str = "median") -> dict[str, float]:
    """Fill value per column: exact median, or mean."""
    if strategy == "median":
        return {c: q[0] for c, q in column_quantiles(df, columns, [0.5]).items()}
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return row.asDict()


def impute_numeric(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})


def fit_mode(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties; counted in parallel, one row kept per column."""
    parts = [
        df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).count().orderBy(F.desc("count"), "v").limit(1)
        .select(F.lit(c).alias("column"), F.col("v").cast("string").alias("value"))
        for c in columns
    ]
    return {r["column"]: r["value"] for r in reduce(DataFrame.unionByName, parts).collect()}


def impute_mode(df: DataFrame, fills: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fills.items()})


def columns_with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """0/1 column per column that had missing values when fitted."""
    return df.withColumns({f"missing_{c}": F.col(c).isNull().cast("double") for c in columns})


def fit_robust(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) per column from exact quantiles; range 0 becomes 1."""
    got = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    return {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in got.items() if q[1] is not None}


def fit_standard(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column; std 0 becomes 1."""
    row = df.agg(*[e for c in columns for e in (F.avg(c), F.stddev_pop(c))]).first()
    return {c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(columns) if row[2 * i] is not None}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items() if c in df.columns})


def inverse_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in fitted.items() if c in df.columns})


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*constant_columns(df, columns))


# ---- categories ----

def category_dictionary(df: DataFrame, columns: list[str], null_label: str | None = None) -> DataFrame:
    """(column, value, code): distinct values numbered from 0 in value order per column."""
    parts = []
    for c in columns:
        v = F.col(c).cast("string")
        v = F.coalesce(v, F.lit(null_label)) if null_label is not None else v
        parts.append(df.groupBy(v.alias("value")).agg(F.lit(c).alias("column")).where(F.col("value").isNotNull()))
    return row_positions(reduce(DataFrame.unionByName, parts), ["column"], ["value"], "code")


def ordinal_encode(
    df: DataFrame, columns: list[str], dictionary: DataFrame, unseen: int | None = 0, null_label: str | None = None
) -> DataFrame:
    """Replace each column by its code; an unseen value (and NULL without a label) becomes `unseen`."""
    for c in columns:
        side = maybe_broadcast(dictionary.where(F.col("column") == c).select(
            F.col("value").alias("__v"), F.col("code").alias("__code")))
        v = F.col(c).cast("string")
        v = F.coalesce(v, F.lit(null_label)) if null_label is not None else v
        code = F.col("__code") if unseen is None else F.coalesce("__code", F.lit(unseen))
        df = df.join(side, v == F.col("__v"), "left").withColumn(c, code.cast("bigint")).drop("__v", "__code")
    return df


def decode(df: DataFrame, column: str, dictionary: DataFrame, source: str) -> DataFrame:
    """Codes back to values of the dictionary's `source` column."""
    side = maybe_broadcast(dictionary.where(F.col("column") == source).select(
        F.col("code").alias("__code"), F.col("value").alias("__v")))
    return df.join(side, F.col(column) == F.col("__code"), "left").withColumn(column, F.col("__v")).drop("__v", "__code")


def one_hot(df: DataFrame, columns: list[str], dictionary: DataFrame) -> DataFrame:
    """Sparse 0/1 vector `<column>_vec` over the sorted categories; unseen and NULL give all zeros."""
    sizes = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count("*").alias("n")).collect()}
    for c in columns:
        n = sizes.get(c, 0)
        df = ordinal_encode(df.withColumn("__raw", F.col(c)), [c], dictionary, unseen=n)
        # one row with the "unseen" code fixes the vector length; that last place is then dropped
        shape = df.sparkSession.range(1).select(F.lit(float(n)).alias(c))
        encoder = OneHotEncoder(inputCols=[c], outputCols=[f"{c}_vec"], dropLast=True).fit(shape)
        df = encoder.transform(df.withColumn(c, F.col(c).cast("double"))).withColumn(c, F.col("__raw")).drop("__raw")
    return df


# ---- combined preprocessing ----

NULL_LABEL = "nan"


class CombinedModel:
    """Label codes for text, then standard scaling of every column.

    When fitting, missing numbers take the median; when transforming later data,
    missing columns and numbers are 0 before scaling.
    """

    def __init__(self, columns: list[str], texts: list[str], dictionary: DataFrame | None, medians: dict, scaling: dict):
        self.columns, self.texts, self.dictionary = columns, texts, dictionary
        self.medians, self.scaling = medians, scaling

    @classmethod
    def fit(cls, df: DataFrame) -> CombinedModel:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        numbers = [c for c in df.columns if c not in texts]
        dictionary = category_dictionary(df, texts, NULL_LABEL) if texts else None
        medians = {c: q[0] for c, q in column_quantiles(_as_double(df, numbers), numbers, [0.5]).items()}
        model = cls(df.columns, texts, dictionary, medians, {})
        model.scaling = fit_standard(model._coded(df, medians), df.columns)
        return model

    def _coded(self, df: DataFrame, fills: dict) -> DataFrame:
        if self.texts:
            df = ordinal_encode(df, self.texts, self.dictionary, 0, NULL_LABEL)
        numbers = [c for c in self.columns if c not in self.texts]
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fills.get(c, 0.0))) for c in numbers})

    def fit_rows(self, df: DataFrame) -> DataFrame:
        """The fitted rows themselves: missing numbers are medians."""
        return scale(self._coded(df, self.medians), self.scaling)

    def transform(self, df: DataFrame) -> DataFrame:
        return scale(self._coded(align_features(df, self.columns, extra=True), {}), self.scaling)


def _as_double(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns}) if columns else df


def align_features(df: DataFrame, columns: list[str], extra: bool = False) -> DataFrame:
    """The wanted columns in order; a missing column is 0. `extra` keeps the others behind them."""
    wanted = [F.col(c) if c in df.columns else F.lit(0).alias(c) for c in columns]
    rest = [F.col(c) for c in df.columns if c not in columns] if extra else []
    return df.select(*wanted, *rest)


def align_and_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wanted columns in order, missing columns and values 0, other columns dropped."""
    return df.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in df.columns else F.lit(0).alias(c) for c in columns])


# ---- the whole column transformer as one Estimator ----

class _PreprocessParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    numericStrategy = Param(Params._dummy(), "numericStrategy", "median or mean", TypeConverters.toString)
    robust = Param(Params._dummy(), "robust", "robust instead of standard scaling", TypeConverters.toBoolean)
    addIndicator = Param(Params._dummy(), "addIndicator", "add missing indicators", TypeConverters.toBoolean)
    encoding = Param(Params._dummy(), "encoding", "onehot or ordinal", TypeConverters.toString)
    scaleNumeric = Param(Params._dummy(), "scaleNumeric", "scale numeric columns", TypeConverters.toBoolean)
    categoricalFill = Param(Params._dummy(), "categoricalFill", "constant for missing categories instead of the mode", TypeConverters.toString)
    dropHighMissing = Param(Params._dummy(), "dropHighMissing", "drop columns with a larger missing share", TypeConverters.toFloat)
    state = Param(Params._dummy(), "state", "fitted parameters as JSON", TypeConverters.toString)


class TabularPreprocessor(Estimator, _PreprocessParams, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric branch (fill, indicator, scale, drop constants) and categorical branch
    (mode or a constant, one-hot or codes), assembled into one sparse or dense vector.

    Categories are a stored table, joined when transforming, so their number is not limited.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", numericStrategy="median", robust=True,
                 addIndicator=True, encoding="onehot", scaleNumeric=True, categoricalFill=None, dropHighMissing=HIGH_MISSING):
        super().__init__()
        self._setDefault(outputCol="features", numericStrategy="median", robust=True, addIndicator=True, encoding="onehot",
                         scaleNumeric=True, categoricalFill="", dropHighMissing=HIGH_MISSING)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TabularPreprocessorModel:
        g = self.getOrDefault
        x = nan_to_null(df.select(*g("inputCols")))
        x = drop_high_missing(x, g("dropHighMissing"))
        kinds = {r["column"]: r["kind"] for r in identify_columns(x).collect()}
        numbers = [c for c in x.columns if kinds[c] == "numeric"]
        cats = [c for c in x.columns if kinds[c] == "categorical"]
        state = {"numbers": numbers, "cats": cats, "encoding": g("encoding"), "fills": {}, "modes": {}, "scaling": {},
                 "indicators": [], "sizes": {}, "categories": "", "dropped": [c for c in g("inputCols") if c not in x.columns]}
        if numbers:
            state["fills"] = fit_fill(x, numbers, g("numericStrategy"))
            gaps = columns_with_nulls(x, numbers) if g("addIndicator") else []
            state["indicators"] = gaps
            full = missing_indicators(x, gaps)
            full = impute_numeric(full, state["fills"])
            names = numbers + [f"missing_{c}" for c in gaps]
            fit = fit_robust if g("robust") else fit_standard
            state["scaling"] = fit(full, names) if g("scaleNumeric") else {c: (0.0, 1.0) for c in names}
            constant = set(constant_columns(full, names))
            state["kept"] = [c for c in names if c not in constant]
        if cats:
            fill = g("categoricalFill")
            state["modes"] = {c: fill for c in cats} if fill else fit_mode(x, cats)
            state["cat_gaps"] = columns_with_nulls(x, cats) if g("addIndicator") else []
            filled = x.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(state["modes"].get(c))) for c in cats})
            state["categories"] = scratch(df.sparkSession, "categories")
            category_dictionary(filled, cats).write.parquet(state["categories"])
            dictionary = df.sparkSession.read.parquet(state["categories"])
            state["sizes"] = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}  # a row per column
        model = TabularPreprocessorModel()
        model._set(outputCol=g("outputCol"), state=json.dumps(state))
        return model


class _ModelWriter(DefaultParamsWriter):
    """Saves the category table below the model's own path, so that the model outlives the session that fitted it."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        stored = self.instance.info()["categories"]
        if stored:
            SparkSession.active().read.parquet(stored).write.parquet(f"{path}/categories")


class _ModelReader(DefaultParamsReader):
    def load(self, path: str) -> TabularPreprocessorModel:
        model = super().load(path)
        state = model.info()
        if state["categories"]:
            model._set(state=json.dumps(state | {"categories": f"{path}/categories"}))
        return model


class TabularPreprocessorModel(Model, _PreprocessParams, MLReadable, MLWritable):
    def write(self) -> _ModelWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> _ModelReader:
        return _ModelReader(cls)

    def info(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    def dictionary(self) -> DataFrame:
        """(column, value, code) of all categories: a table in the shared folder, or below the path the model was loaded from."""
        return SparkSession.active().read.parquet(self.info()["categories"])

    def feature_names(self) -> list[str]:
        """One name per place of the vector."""
        s = self.info()
        names = list(s.get("kept", []))
        values: dict[str, list[str]] = {}
        if s["cats"] and s["encoding"] == "onehot":
            for r in self.dictionary().orderBy("column", "code").collect():
                values.setdefault(r["column"], []).append(r["value"])
        for c in s["cats"]:
            if s["encoding"] == "onehot":
                names += [f"{c}_{v}" for v in values.get(c, [])]
            else:
                names.append(c)
        for c in s.get("cat_gaps", []):
            names += [f"missing_{c}_{v}" for v in ("False", "True")] if s["encoding"] == "onehot" else [f"missing_{c}"]
        return names

    def _transform(self, df: DataFrame) -> DataFrame:
        s, output = self.info(), self.getOrDefault("outputCol")
        parts: list[Column] = []
        for c in s.get("kept", []):
            centre, spread = s["scaling"][c]
            if c.startswith("missing_") and c not in s["numbers"]:
                x = F.col(c[len("missing_"):]).isNull().cast("double")
            else:
                x = F.coalesce(F.col(c).cast("double"), F.lit(s["fills"][c]))
            parts.append((x - F.lit(centre)) / F.lit(spread))
        gaps: list[Column] = []
        for c in s.get("cat_gaps", []):
            gap = F.col(c).isNull()
            gaps += [x.cast("double") for x in ([~gap, gap] if s["encoding"] == "onehot" else [gap])]
        # the input columns travel in a struct; encoding works on copies
        row = nan_to_null(df)
        box = row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias("__row"), *[
            F.coalesce(F.col(c).cast("string"), F.lit(s["modes"].get(c))).alias(f"__c{i}") for i, c in enumerate(s["cats"])],
            array_to_vector(nan_safe(F.array(*parts).cast("array<double>"))).alias("__numbers"),
            array_to_vector(nan_safe(F.array(*gaps).cast("array<double>"))).alias("__gaps"))
        pieces = ["__numbers"]
        if s["cats"]:
            codes = [f"__c{i}" for i in range(len(s["cats"]))]
            renamed = self.dictionary().join(F.broadcast(values_frame(df.sparkSession, list(zip(s["cats"], codes)), "column string, short string")), "column")
            dictionary = renamed.select(F.col("short").alias("column"), "value", "code")
            if s["encoding"] == "onehot":
                box = one_hot(box, codes, dictionary)
                pieces += [f"{c}_vec" for c in codes]
            else:
                box = ordinal_encode(box, codes, dictionary)
                box = box.withColumns({c: F.col(c).cast("double") for c in codes})
                pieces += codes
        out = VectorAssembler(inputCols=[*pieces, "__gaps"], outputCol="__features").transform(box)
        return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in row.columns if c != output], F.col("__features").alias(output))

    def inverse_numbers(self, df: DataFrame) -> DataFrame:
        """Add `inverse`, a struct of the numeric columns in their own units, read back from the vector."""
        s = self.info()
        x = vector_to_array(self.getOrDefault("outputCol"))
        cells = [(x[i] * s["scaling"][c][1] + s["scaling"][c][0]).alias(c) for i, c in enumerate(s.get("kept", [])) if c in s["numbers"]]
        return df.withColumn("inverse", F.struct(*cells)) if cells else df


def nan_safe(values: Column) -> Column:
    return F.transform(values, lambda v: F.coalesce(v, F.lit(0.0)))


def preprocessing_info(model: TabularPreprocessorModel, spark) -> DataFrame:
    """One row: columns in and out and the settings."""
    s = model.info()
    names = model.feature_names()
    return spark.range(1).select(
        F.lit(",".join(s["numbers"])).alias("numeric_columns"), F.lit(",".join(s["cats"])).alias("categorical_columns"),
        F.lit(s["encoding"]).alias("encoding"), F.lit(len(s["numbers"]) + len(s["cats"])).alias("n_features_in"),
        F.lit(len(names)).alias("n_features_out"), F.lit(",".join(names)).alias("feature_names_out"))


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="skip").transform(df)
