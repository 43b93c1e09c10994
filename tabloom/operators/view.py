"""Looking at tables: preview, search, sort, pages, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.cells import is_numeric, nan_to_null
from tabloom.operators.profile import distinct_counts, top_values, wide_stats
from tabloom.session import beside

PREVIEW_ROWS = 500
PAGE_ROWS = 50


def preview(df: DataFrame, order: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in key order beside the table size."""
    size = df.agg(F.count(F.lit(1)).alias("total_rows"))
    head = nan_to_null(df).orderBy(*order).limit(rows)
    return beside(head, size).withColumns({
        "total_columns": F.lit(len(df.columns)), "truncated": F.col("total_rows") > rows})


def preview_column_stats(df: DataFrame, top: int = 5) -> DataFrame:
    """Per column: nulls, distinct values, range, mean (4 digits), top values, kind."""
    kinds = {f.name: "numeric" if is_numeric(f.dataType)
             else "categorical" if isinstance(f.dataType, T.StringType) else "other" for f in df.schema.fields}
    kind = F.create_map(*[e for c, k in kinds.items() for e in (F.lit(c), F.lit(k))])
    texts = [c for c, k in kinds.items() if k == "categorical"]
    stats = wide_stats(df).join(F.broadcast(distinct_counts(df, df.columns)), "column").select(
        "column", "dtype", F.col("missing_count").alias("null_count"), "unique_count", "min", "max",
        F.bround("mean", 4).alias("mean"), F.element_at(kind, F.col("column")).alias("kind"))
    if not texts:
        return stats.withColumn("top_values", F.lit(None).cast("string"))
    shown = F.concat_ws("=", "value", F.col("n").cast("string"))
    tops = top_values(df, texts, top).groupBy("column").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", shown.alias("t")))), lambda x: x["t"]), ";")
        .alias("top_values"))
    return stats.join(F.broadcast(tops), "column", "left")  # `top` values per column


def search_any_column(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any value contains the text, ignoring case."""
    cells = F.array(*[F.lower(F.col(c).cast("string")) for c in df.columns])
    return df.where(F.exists(cells, lambda v: F.coalesce(F.contains(v, F.lit(text.lower())), F.lit(False))))


def sort_nulls_last(df: DataFrame, column: str, descending: bool = False, *tie: str) -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *tie)


def paginate(df: DataFrame, order: list[Column | str], page: int, size: int = PAGE_ROWS) -> DataFrame:
    """Page `page` (from 1) beside the row and page totals."""
    totals = df.agg(F.count(F.lit(1)).alias("total"))
    part = df.orderBy(*order).offset(size * (page - 1)).limit(size)
    return beside(part, totals).withColumns({
        "page": F.lit(page), "pages": F.greatest(F.ceil(F.col("total") / size), F.lit(1))})


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def leaderboard(scores: DataFrame, group: list[str], top: int = 3) -> DataFrame:
    """Rank models by score within each group; earlier position wins a tie.

    A group is one experiment: it holds as many rows as there are models.
    """
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last("score"), "position")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.withColumns({"best": F.col("rank") == 1, "in_top": F.col("rank") <= top})


def search_models(models: DataFrame, text: str, packaged: bool = False, limit: int | None = None) -> DataFrame:
    """Newest first, name contains the text ignoring case, optionally only packaged models."""
    hits = models.where(F.contains(F.lower("name"), F.lit(text.lower())))
    if packaged:
        hits = hits.where(F.col("package_path").isNotNull())
    hits = hits.orderBy(F.desc("created_at"), "id")
    return hits.limit(limit) if limit else hits


def dashboard_summary(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Counts, best score and the problem types seen."""
    d = datasets.agg(F.count(F.lit(1)).alias("total_datasets"))
    types = models.where(F.col("problem_type").isNotNull()).groupBy("problem_type").agg(F.lit(1).alias("one"))
    t = types.agg(F.array_join(F.sort_array(F.collect_list("problem_type")), ", ").alias("types"))
    m = models.agg(F.count(F.lit(1)).alias("trained_models"), F.max(F.coalesce("best_score", F.lit(0.0))).alias("best_score"))
    return beside(beside(d, m), t)
