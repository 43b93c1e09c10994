"""Header repair over tables of column names: one row per (table, position, name).

Works for any number of tables at once. `group` names the table key columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.cells import is_numeric, is_numeric_like, pandas_dtype
from tabloom.functions.quantiles import column_quantiles
from tabloom.operators.profile import first_categories, wide_stats
from tabloom.session import maybe_broadcast

MAX_NAME = 64
# Names that say nothing, matched against the whole lower-case name.
GENERIC_NAME = r"^(col|column|field|feature|value)_?\d+$"
# Names of the well-known 14-column housing table.
HOUSING_COLUMNS = [
    "crime_rate", "residential_zone", "industrial_area", "charles_river_boundary", "nitric_oxide_concentration",
    "average_rooms", "older_home_percentage", "employment_center_distance", "highway_access_index",
    "property_tax_rate", "pupil_teacher_ratio", "black_population_index", "lower_status_percentage",
    "median_home_value",
]


def data_like(name: Column) -> Column:
    return is_numeric_like(name) | F.ltrim(name).startswith("Unnamed:")


def detect_headers(headers: DataFrame, group: list[str], name: str = "name") -> DataFrame:
    """Per table: share of names that look like data, and whether the header row is missing."""
    share = F.avg(data_like(F.col(name)).cast("int"))
    return headers.groupBy(*group).agg(share.alias("data_like"), (share >= 0.8).alias("headers_missing"))


def snake_case(name: Column, fallback: Column) -> Column:
    """Lower-case words joined by `_`; the fallback for an empty or digit-first name."""
    clean = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_")
    clean = F.regexp_replace(clean, "^_+|_+$", "")
    return F.substring(F.when(clean.rlike("^[a-z]"), clean).otherwise(fallback), 1, MAX_NAME)


def snake_case_headers(headers: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    fallback = F.concat(F.lit("col_"), F.col(pos).cast("string"))
    return headers.withColumn("clean", snake_case(F.col(name), fallback))


def dedupe_headers(headers: DataFrame, group: list[str], name: str = "name", pos: str = "pos") -> DataFrame:
    """The nth repeat of a clean name inside its table gets the suffix `_n`.

    The window key is (table, name): its size is bounded by the columns of one table.
    """
    clean = snake_case_headers(headers, name, pos)
    seen = F.row_number().over(Window.partitionBy(*group, "clean").orderBy(pos)) - 1
    return clean.withColumn("__seen", seen).withColumn(
        "header", F.when(F.col("__seen") == 0, F.col("clean")).otherwise(
            F.concat("clean", F.lit("_"), F.col("__seen").cast("string")))).drop("__seen")


def generic_header_ratio(headers: DataFrame, group: list[str], name: str = "name") -> DataFrame:
    """Per table: share of meaningless names, and whether they are the majority."""
    share = F.avg(F.lower(F.trim(F.col(name))).rlike(GENERIC_NAME).cast("int"))
    return headers.groupBy(*group).agg(share.alias("generic"), (share > 0.5).alias("too_generic"))


def canonical_headers(tables: DataFrame) -> DataFrame:
    """(context, n_columns) rows with the trusted names where a known table is recognised."""
    known = (F.col("n_columns") == len(HOUSING_COLUMNS)) & F.contains(F.lower("context"), F.lit("housing"))
    return tables.withColumn("headers", F.when(known, F.array(*[F.lit(c) for c in HOUSING_COLUMNS])))


def set_headers(df: DataFrame, names: list[str]) -> DataFrame:
    """Apply confirmed names; their number must match."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def column_info(df: DataFrame) -> DataFrame:
    """dtype and null count per column."""
    return wide_stats(df).select("column", "dtype", F.col("missing_count").alias("null_count"))


def feature_schema(df: DataFrame, target: str, categories: int = 50) -> DataFrame:
    """Per feature: dtype, missing, kind, numeric summary, first categories (joined by `;`)."""
    fields = [f for f in df.schema.fields if f.name != target]
    numbers = [f.name for f in fields if is_numeric(f.dataType)]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    medians = column_quantiles(df, numbers, [0.5])
    pairs = [e for c in numbers for e in (F.lit(c), F.lit(medians[c][0]).cast("double"))]
    median = F.element_at(F.create_map(*pairs), F.col("column")) if pairs else F.lit(None).cast("double")
    kind = {f.name: "numeric" if f.name in numbers else "categorical" if f.name in texts
            else "boolean" if isinstance(f.dataType, T.BooleanType) else "unknown" for f in fields}
    kinds = F.create_map(*[e for c, k in kind.items() for e in (F.lit(c), F.lit(k))])
    base = wide_stats(df, [f.name for f in fields]).select(
        "column", "dtype", "missing_count", F.element_at(kinds, F.col("column")).alias("semantic_type"),
        "min", "max", "mean", median.alias("median"))
    if not texts:
        return base.withColumn("categories", F.lit(None).cast("string"))
    cats = first_categories(df, texts, categories).groupBy("column").agg(
        F.array_join(F.sort_array(F.collect_list("value")), ";").alias("categories"))
    return base.join(F.broadcast(cats), "column", "left")  # at most `categories` values per column


def ui_schema(schema: DataFrame) -> DataFrame:
    """Form field per feature of a `feature_schema` table."""
    cat = (F.col("semantic_type") == "categorical") | F.col("dtype").isin("object", "category")
    num = (F.col("semantic_type") == "numeric") | F.col("dtype").isin("int64", "float64", "int32", "float32")
    return schema.select(
        F.col("column").alias("name"),
        F.initcap(F.replace("column", F.lit("_"), F.lit(" "))).alias("label"),
        F.lit(True).alias("required"),
        F.when(cat, "categorical").when(num, "number").when(F.col("semantic_type") == "boolean", "boolean")
        .otherwise("text").alias("type"),
        F.when(cat, "dropdown").when(num, "number").when(F.col("semantic_type") == "boolean", "checkbox")
        .otherwise("text").alias("input_type"),
        F.when(cat, F.col("categories")).alias("options"),
        F.when(~cat & num, F.col("min")).alias("min"),
        F.when(~cat & num, F.col("max")).alias("max"),
        # a mean of exactly zero counts as no mean
        F.when(~cat & num, F.coalesce(F.nullif(F.col("mean"), F.lit(0.0)), F.col("median"))).alias("default"),
    )


def looks_like_data(name: Column) -> Column:
    """A column name holding two decimal numbers is a data row, not a header."""
    return name.rlike(r"\d+\.\d+.*\d+\.\d+")


def target_preflight(columns: DataFrame, targets: DataFrame, table: str, name: str = "name") -> DataFrame:
    """Checks before training, for many tables at once.

    columns: (table, name) one row per column; targets: (table, target). The target
    must exist, must not look like a data row, and must leave at least one feature.
    """
    wanted = targets.select(table, "target").distinct()
    seen = columns.join(wanted, table).groupBy(table, "target").agg(
        F.bool_or(F.col(name) == F.col("target")).alias("exists"),
        (F.count_if(F.col(name) != F.col("target")) >= 1).alias("has_features"))
    out = seen.withColumn("name_is_data", looks_like_data(F.col("target")))
    return out.withColumn("ok", F.col("exists") & ~F.col("name_is_data") & F.col("has_features"))


def close_column_match(columns: DataFrame, suggestions: DataFrame) -> DataFrame:
    """First column that equals or contains a suggested name, ignoring case.

    columns: (column, pos) of one table, a checked small side; suggestions: (suggested).
    """
    lowered, wanted = F.lower("column"), F.lower("suggested")
    hits = suggestions.join(maybe_broadcast(columns), F.contains(lowered, wanted))
    return hits.groupBy("suggested").agg(F.min_by("column", "pos").alias("column"))
