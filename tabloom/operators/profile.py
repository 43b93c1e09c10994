"""Dataset profile: per-column statistics, duplicates, correlations, quality score.

Columns are profiled by two kinds of job: one wide aggregate (counts and moments),
and one typed `groupBy` per column for distinct values, each reading that column
only. Results are long DataFrames with one row per column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.cells import is_numeric, numeric_columns, pandas_dtype, round_exact, string_columns
from tabloom.functions.quantiles import DIRECT_ROWS, column_quantiles
from tabloom.session import beside

# columns (or column pairs) per aggregate: keeps generated code small, and blocks run side by side,
# each scanning only its columns
COLUMNS_PER_AGG = 3

# Name parts that mark a column as a time column, and the shorter list for series data.
TIME_NAME_PARTS = ["date", "time", "datetime", "timestamp", "created", "updated"]
SERIES_NAME_PARTS = ["date", "time", "datetime", "timestamp"]


def name_has(column: Column, parts: list[str]) -> Column:
    lowered = F.lower(column)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in parts])


def semantic_type(column: Column, dtype: Column, uniques: Column, rows: Column) -> Column:
    """Ordered rules over a column's name, dtype and number of distinct values."""
    text = dtype == "object"
    number = dtype.rlike("^(u?int|float)")
    return (
        F.when(name_has(column, TIME_NAME_PARTS), "timestamp")
        .when(F.contains(F.lower(column), F.lit("id")), "identifier")
        .when(text & (uniques / rows < 0.05), "categorical")
        .when(text, "text")
        .when(number & (uniques <= 10), "categorical")
        .when(number, "numeric")
        .otherwise("unknown")
    )


def _skewness(x: Column, n: Column) -> Column:
    """Bias-corrected; 0 for a constant column of three or more values."""
    spread = F.stddev_pop(x)
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(spread == 0, 0.0).otherwise(F.skewness(x) * factor)


def _stats_struct(field: T.StructField) -> Column:
    c = F.col(field.name)
    n = F.count(c)
    numeric, dated = is_numeric(field.dataType), isinstance(field.dataType, (T.TimestampType, T.DateType))
    none = F.lit(None)
    x = c.cast("double") if numeric else None
    num = (lambda e: e.cast("double")) if numeric else (lambda e: none.cast("double"))
    cnt = (lambda e: e.cast("bigint")) if numeric else (lambda e: none.cast("bigint"))
    day = 86_400_000_000
    return F.struct(
        F.lit(field.name).alias("column"),
        F.lit(pandas_dtype(field.dataType)).alias("dtype"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(c.isNull()).alias("missing_count"),
        num(F.min(x) if numeric else none).alias("min"),
        num(F.max(x) if numeric else none).alias("max"),
        num(F.avg(x) if numeric else none).alias("mean"),
        num(F.stddev_samp(x) if numeric else none).alias("std"),
        num(_skewness(x, n) if numeric else none).alias("skewness"),
        cnt(F.count_if(x == 0) if numeric else none).alias("zeros"),
        cnt(F.count_if(x < 0) if numeric else none).alias("negatives"),
        (F.min(c) if dated else none).cast("timestamp").alias("min_date"),
        (F.max(c) if dated else none).cast("timestamp").alias("max_date"),
        (F.floor((F.unix_micros(F.max(c.cast("timestamp"))) - F.unix_micros(F.min(c.cast("timestamp")))) / day)
         if dated else none).cast("bigint").alias("range_days"),
    )


def wide_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts, moments and date range, from one aggregate per block of columns."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    blocks = [fields[i:i + COLUMNS_PER_AGG] for i in range(0, len(fields), COLUMNS_PER_AGG)]
    parts = [df.agg(F.array(*[_stats_struct(f) for f in b]).alias("s")).selectExpr("inline(s)") for b in blocks]
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of the non-null values; every branch scans one column only."""
    parts = [
        df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).count()
        .select(F.lit(c).alias("column"), F.col("v").cast("string").alias("value"), F.col("count").alias("n"))
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, unique_count); `approximate` trades exactness for one pass with a fixed-size sketch."""
    if approximate:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c).alias("unique_count"))
                          for c in columns])
        return df.agg(pairs.alias("s")).selectExpr("inline(s)")
    parts = [
        df.groupBy(F.col(c).alias("v")).agg(F.lit(1).alias("one")).agg(F.count("v").alias("unique_count"))
        .select(F.lit(c).alias("column"), "unique_count")
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: dtype, missing count and share, distinct values, semantic type."""
    stats = wide_stats(df).select("column", "dtype", "rows", "missing_count")
    uniques = distinct_counts(df, df.columns, approximate)
    joined = stats.join(F.broadcast(uniques), "column")  # one row per column of the schema
    return joined.select(
        "column", "dtype", "missing_count",
        (F.col("missing_count") / F.col("rows") * 100).alias("missing_pct"),
        "unique_count",
        semantic_type(F.col("column"), F.col("dtype"), F.col("unique_count"), F.col("rows")).alias("semantic_type"),
    )


def numeric_stats(df: DataFrame, columns: list[str] | None = None, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Min, max, mean, exact median, sample std, bias-corrected skewness, zeros, negatives."""
    columns = columns or numeric_columns(df)
    medians = column_quantiles(df, columns, [0.5], direct_rows)
    lookup = F.create_map(*[e for c in columns for e in (F.lit(c), F.lit(medians[c][0]).cast("double"))])
    return wide_stats(df, columns).select(
        "column", "min", "max", "mean", F.element_at(lookup, F.col("column")).alias("median"),
        "std", "skewness", "zeros", "negatives")


def profile_dataset(df: DataFrame, approximate: bool = False) -> DataFrame:
    """The whole per-column profile in one long table."""
    stats = wide_stats(df)
    uniques = distinct_counts(df, df.columns, approximate)
    numbers = numeric_columns(df)
    medians = column_quantiles(df, numbers, [0.5])
    pairs = [e for c in numbers for e in (F.lit(c), F.lit(medians[c][0]).cast("double"))]
    median = F.element_at(F.create_map(*pairs), F.col("column")) if pairs else F.lit(None).cast("double")
    return stats.join(F.broadcast(uniques), "column").select(
        "column", "dtype", "missing_count",
        (F.col("missing_count") / F.col("rows") * 100).alias("missing_pct"),
        "unique_count",
        semantic_type(F.col("column"), F.col("dtype"), F.col("unique_count"), F.col("rows")).alias("semantic_type"),
        "min", "max", "mean", median.alias("median"), "std", "skewness", "zeros", "negatives",
        "min_date", "max_date", "range_days",
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column, ties in value order.

    Spark keeps only the first k rows per column inside every map task
    (window group limit), so a column of many values does not meet in one task.
    """
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    counts = value_counts(df, columns or string_columns(df))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_categories(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """Up to k distinct values per column in value order."""
    w = Window.partitionBy("column").orderBy("value")
    ranked = value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("column", "value", "rank")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (NULLs equal): count and percentage."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_pct", F.try_divide(F.col("duplicate_rows") * 100.0, F.col("rows")))


def basic_info(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows."""
    return duplicate_rows(df).select(
        F.col("rows").alias("num_rows"), F.lit(len(df.columns)).alias("num_columns"), "duplicate_rows")


def estimated_bytes(df: DataFrame) -> DataFrame:
    """Logical size: fixed width per value, text by its bytes."""
    # Bytes per value by type.
    widths = {"bigint": 8, "double": 8, "timestamp": 8, "int": 4, "float": 4, "date": 4,
              "smallint": 2, "tinyint": 1, "boolean": 1}
    fixed = sum(widths.get(f.dataType.simpleString(), 0) for f in df.schema.fields)
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in string_columns(df)]
    total = reduce(lambda a, b: a + b, texts, F.count(F.lit(1)) * fixed)
    return df.agg(total.cast("bigint").alias("bytes")).withColumn("mb", F.col("bytes") / (1024 * 1024))


def missing_summary(df: DataFrame) -> DataFrame:
    """Per column missing count and share beside the table totals."""
    per = wide_stats(df).select("column", "rows", "missing_count")
    totals = per.agg(F.sum("missing_count").alias("total_missing"),
                     F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"))
    return beside(per, totals).select(
        "column", "missing_count", (F.col("missing_count") / F.col("rows") * 100).alias("missing_pct"),
        "total_missing", "columns_with_missing")


def _pair_corr(a: str, b: str) -> Column:
    """Pairwise-complete Pearson; NULL when either side is constant."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))


#: Columns of a block of the correlation matrix: what a task sends is a few matrices of this size per pair of blocks.
CORR_BLOCK = 64
_MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy")


def _moments(x: np.ndarray, seen: np.ndarray, y: np.ndarray, also: np.ndarray, sums: np.ndarray) -> None:
    """Add the pairwise-complete sums of two blocks of columns, zero where not seen."""
    for k, (left, right) in enumerate(((seen, also), (x, also), (seen, y), (x * x, also), (seen, y * y), (x, y))):
        sums[k] += left.T @ right


def _centred(sums: np.ndarray, shift_x: np.ndarray, shift_y: np.ndarray) -> np.ndarray:
    """Counts, means and central moments from sums of shifted values."""
    n, sx, sy, sxx, syy, sxy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        mx, my = np.nan_to_num(sx / n), np.nan_to_num(sy / n)
    cxx, cyy = sxx - mx * sx, syy - my * sy
    # a column that is constant beside another one leaves rounding alone
    cxx[cxx <= 1e-13 * sxx], cyy[cyy <= 1e-13 * syy] = 0, 0
    return np.stack([n, np.where(n > 0, mx + shift_x[:, None], 0), np.where(n > 0, my + shift_y[None, :], 0), cxx, cyy, sxy - mx * sy])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two disjoint sets of rows taken together."""
    n = a[0] + b[0]
    part = np.where(n > 0, b[0] / np.maximum(n, 1), 0.0)
    dx, dy = np.where(a[0] * b[0] > 0, b[1] - a[1], 0.0), np.where(a[0] * b[0] > 0, b[2] - a[2], 0.0)
    both = a[0] * part
    means = [np.where(a[0] > 0, a[k] + d * part, b[k]) for k, d in ((1, dx), (2, dy))]
    return np.stack([n, *means, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both])


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, corr) for every ordered pair, over the rows where both are there; no rows for fewer than two numeric columns.

    One scan whatever the number of columns: a task adds up masked cross products block by block and sends their central
    moments, which are merged exactly. Null and not-a-number count as missing; a constant column has null correlations.
    """
    columns = columns or numeric_columns(df)
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "a string, b string, corr double")
    cuts = [(k, min(k + CORR_BLOCK, len(columns))) for k in range(0, len(columns), CORR_BLOCK)]
    blocks = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]
    sizes = [b - a for a, b in cuts]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.full(len(columns), np.nan)
        sums = {(i, j): np.zeros((6, sizes[i], sizes[j])) for i, j in blocks}
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                x = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))], axis=1)
                seen = ~np.isnan(x)
                first = x[seen.argmax(axis=0), np.arange(len(columns))]
                shift = np.where(np.isnan(shift), first, shift)
                x = np.where(seen, x - shift, 0.0)
                own = seen.astype(float)
                for (i, j), held in sums.items():
                    (a, b), (c, d) = cuts[i], cuts[j]
                    _moments(x[:, a:b], own[:, a:b], x[:, c:d], own[:, c:d], held)
        shift = np.nan_to_num(shift)
        flat = [_centred(held, shift[slice(*cuts[i])], shift[slice(*cuts[j])]).ravel() for (i, j), held in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(blocks))), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["block", "moments"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                i, j = blocks[block]
                part = batch.column("moments").slice(k, 1).flatten().to_numpy(zero_copy_only=False)
                part = part.reshape(6, sizes[i], sizes[j]) if len(part) else np.zeros((6, sizes[i], sizes[j]))
                held[block] = _merged(held[block], part) if block in held else part
        out: dict[str, list] = {"a": [], "b": [], "corr": []}
        for block, (n, _, _, cxx, cyy, cxy) in held.items():
            i, j = blocks[block]
            for p in range(sizes[i]):
                for q in range(p if i == j else 0, sizes[j]):
                    spread = math.sqrt(cxx[p, q]) * math.sqrt(cyy[p, q])
                    value = float(cxy[p, q] / spread) if n[p, q] > 0 and spread > 0 else None
                    a, b = columns[cuts[i][0] + p], columns[cuts[j][0] + q]
                    for left, right in {(a, b), (b, a)}:
                        for name, v in zip(out, (left, right, value)):
                            out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.string()), pa.array(out["b"], pa.string()), pa.array(out["corr"], pa.float64())], names=list(out))

    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    parts = numbers.mapInArrow(summed, "block int, moments array<double>")
    # every block has a row, so that a table without any has null correlations
    parts = parts.union(spark.range(len(blocks)).select(F.col("id").cast("int"), F.array().cast("array<double>")))
    return parts.repartition("block").mapInArrow(merged, "a string, b string, corr double")


def target_correlations(df: DataFrame, target: str, k: int = 5, weak: float = 0.05) -> DataFrame:
    """Features by absolute correlation with the target; the first k and a flag for weak ones."""
    features = [c for c in numeric_columns(df) if c != target]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(_pair_corr(c, target)).alias("abs_corr"))
                      for c in features])
    long = df.agg(cells.alias("s")).selectExpr("inline(s)").where(F.col("abs_corr").isNotNull())
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("abs_corr"), "feature")  # one row per column
    ranked = long.withColumn("rank", F.row_number().over(w))
    return ranked.select("feature", "abs_corr", "rank", (F.col("rank") <= k).alias("top"),
                         (F.col("abs_corr") < weak).alias("weak"))


def quality_score(df: DataFrame) -> DataFrame:
    """100 minus missing share (up to 30) minus duplicate share (up to 20)."""
    missing = wide_stats(df).agg(F.sum("missing_count").alias("missing"))
    both = beside(duplicate_rows(df), missing)
    missing_pct = F.col("missing") * 100.0 / (F.col("rows") * len(df.columns))
    score = 100.0 - F.least(missing_pct, F.lit(30.0)) - F.least(F.col("duplicate_pct"), F.lit(20.0))
    return both.select(missing_pct.alias("missing_pct"), "duplicate_pct",
                       F.greatest(F.lit(0.0), round_exact(score, 2)).alias("quality_score"))


def target_analysis(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """The k commonest target values beside its counts and moments."""
    field = df.schema[target]
    number = is_numeric(field.dataType)
    x = F.col(target).cast("double") if number else F.lit(None).cast("double")
    summary = df.agg(
        F.count_if(F.col(target).isNull()).alias("missing_count"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    uniques = distinct_counts(df, [target]).select("unique_count")
    top = top_values(df, [target], k).select("value", "n", "rank")
    return beside(beside(top, summary), uniques)


def class_counts(df: DataFrame, label: str, name: str, samples: int = 3) -> DataFrame:
    """Rows per class and its first names; the rank limit is applied map-side, so a
    class with most of the rows is not sorted in one task."""
    w = Window.partitionBy(label).orderBy(name)
    first = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= samples)
    names = first.groupBy(label).agg(F.array_join(F.sort_array(F.collect_list(name)), ";").alias("samples"))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(names, label)


def class_from_path(path: Column) -> Column:
    """Class folder of an image path; NULL for hidden, system and non-image files."""
    # Image file suffixes.
    image = r"(?i)\.(jpg|jpeg|png|bmp|gif|webp|tiff)$"
    parts = F.split(path, "/")
    depth = F.size(parts)
    last = F.element_at(parts, -1)
    name = (F.when(depth < 2, None).when(depth == 2, F.element_at(parts, 1)).when(depth == 3, F.element_at(parts, 2))
            .otherwise(F.try_element_at(parts, F.lit(-2))))
    keep = last.rlike(image) & ~last.startswith(".") & ~name.startswith("__") & ~name.startswith(".")
    return F.when(keep, name)


def imbalance_flag(df: DataFrame, target: str, limit: float = 0.2) -> DataFrame:
    """Smallest over largest of the top-value counts, flagged at or below `limit`."""
    return top_values(df, [target]).agg(F.min("n").alias("smallest"), F.max("n").alias("largest")).select(
        "smallest", "largest", (F.col("smallest") / F.col("largest")).alias("ratio"),
        (F.col("smallest") / F.col("largest") <= limit).alias("imbalanced"))


def class_weights(df: DataFrame, label: str, n_classes: int | None = None) -> DataFrame:
    """n / (k * n_class) per class id up to the largest; 1.0 for an id with no rows.

    k is the number of known classes, by default those present.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class_id")).agg(F.count("*").alias("n"))
    known = F.count("*") if n_classes is None else F.lit(n_classes)
    span = counts.agg(F.max("class_id").alias("hi"), F.sum("n").alias("total"), known.alias("k"))
    ids = span.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("hi").cast("bigint"))).alias("class_id"),
                      "total", "k")
    return ids.join(counts, "class_id", "left").select(
        "class_id", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.col("total") / (F.col("k") * F.col("n")), F.lit(1.0)).alias("weight"))
