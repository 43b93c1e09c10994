"""Splits by hash of the row key, and generated tables.

Nothing here depends on the number of partitions: a row's side, fold or random
value follows from its key and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.cells import hash_bucket100, normal, row_hash, uniform
from tabloom.functions.ordering import MAX_ROWS, hash_ranks, row_positions
from tabloom.operators.neighbors import knn_join
from tabloom.session import beside, maybe_broadcast

TEST_PERCENT = 20
FOLDS = 5


def train_test_split(df: DataFrame, key: list[str], test_percent: int = TEST_PERCENT) -> DataFrame:
    """Add `part` (train or test); one projection, no shuffle."""
    return df.withColumn("part", F.when(hash_bucket100(row_hash(key)) < test_percent, "test").otherwise("train"))


def stratified_split(
    df: DataFrame, label: str, key: list[str], test_percent: int = TEST_PERCENT, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Add `part` with the rounded share of every class in the test part."""
    ranked = hash_ranks(df.withColumn("__h", row_hash(key)), [label], "__h", "__rank", max_rows)
    sizes = df.groupBy(F.col(label).alias("__y")).agg(F.round(F.count("*") * test_percent / 100).alias("__test"))
    joined = ranked.join(maybe_broadcast(sizes), F.col(label).eqNullSafe(F.col("__y")))
    return joined.withColumn("part", F.when(F.col("__rank") < F.col("__test"), "test").otherwise("train")).drop(
        "__h", "__rank", "__y", "__test")


def kfold_assign(
    df: DataFrame, key: list[str], label: str | None = None, folds: int = FOLDS, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Add `fold`, even within each class when a label is given."""
    ranked = hash_ranks(df.withColumn("__h", row_hash(key)), [label] if label else [], "__h", "__rank", max_rows)
    return ranked.withColumn("fold", (F.col("__rank") % folds).cast("int")).drop("__h", "__rank")


# Letters of generated text and the span of generated dates.
LETTERS = "abcdefghijklmnopqrstuvwxyz "
FIRST_DATE, LAST_DATE = "2020-01-01", "2025-12-31"


def _generated(spec: dict, seed: int) -> Column:
    """One column of a generated table, from the row id and the column's own seed."""
    kind = spec.get("type", "numeric")
    u = uniform("id", seed=seed)
    lo, hi = spec.get("min", 0), spec.get("max", 100)
    if kind == "integer":
        return (F.floor(u * (hi - lo + 1)) + lo).cast("bigint")
    if kind == "categorical":
        values = spec.get("categories", ["A", "B", "C"])
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
    if kind == "boolean":
        return u < spec.get("true_probability", 0.5)
    if kind == "date":
        start, end = F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date")
        return F.date_format(F.date_add(start, F.floor(u * (F.datediff(end, start) + 1)).cast("int")), "yyyy-MM-dd")
    if kind == "text":
        spots = F.sequence(F.lit(1), F.lit(spec.get("length", 10)))
        letter = lambda i: F.substring(
            F.lit(LETTERS), (F.floor(uniform(F.col("id"), i, seed=seed) * len(LETTERS)) + 1).cast("int"), F.lit(1))
        return F.trim(F.array_join(F.transform(spots, letter), ""))
    if kind == "id":
        return F.format_string("%s_%05d", F.lit(spec.get("prefix", "ID")), F.col("id") + 1)
    return F.round(u * (hi - lo) + lo, spec.get("decimals", 2))


def generate_table(ids: DataFrame, columns: list[dict], seed: int = 42) -> DataFrame:
    """One made-up row per `id` in `ids` (for example `spark.range(n)`), from column specs."""
    return ids.select(*[_generated(c, seed + 7919 * i).alias(c["name"]) for i, c in enumerate(columns)])


def extend_from_seed(
    df: DataFrame, key: str, numeric: list[str], categorical: list[str], copies: int, seed: int = 42
) -> DataFrame:
    """The seed rows and `copies` new rows per seed row.

    Numbers are normal with the seed's mean and spread (at least 0.1), clipped to its
    range. A category is that of a random seed row. The new key continues the seed's
    numbering, so seed keys must be distinct whole numbers.
    """
    moments = df.agg(F.count("*").alias("__n"), F.max(key).alias("__top"), *[
        e for c in numeric for e in (F.avg(c).alias(f"__m_{c}"), F.greatest(F.stddev_pop(c), F.lit(0.1)).alias(f"__s_{c}"),
                                     F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    born = df.select(F.col(key).alias("__src")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    born = beside(born, moments)
    new = born.withColumn(key, F.col("__top") + 1 + F.col("__src") * copies + F.col("__copy"))
    for i, c in enumerate(numeric):
        drawn = F.col(f"__m_{c}") + F.col(f"__s_{c}") * normal("__src", "__copy", seed=seed + 13 * i)
        new = new.withColumn(c, F.least(F.greatest(drawn, F.col(f"__lo_{c}")), F.col(f"__hi_{c}")).cast(df.schema[c].dataType))
    for i, c in enumerate(categorical):
        new = _draw_category(new, df, c, key, seed + 1009 * (i + 1))
    return df.select(key, *numeric, *categorical).withColumn("origin", F.lit("seed")).unionByName(
        new.select(key, *numeric, *categorical).withColumn("origin", F.lit("drawn")))


def _draw_category(new: DataFrame, df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """A uniformly chosen seed row's value: equi join on a random position, spread evenly."""
    known = df.where(F.col(column).isNotNull()).select(key, column)
    placed = row_positions(known, [], [key], "__pos").select("__pos", column)
    total = known.agg(F.count("*").alias("__total"))
    drawn = beside(new, total).withColumn(
        "__u", F.floor(uniform("__src", "__copy", seed=seed) * F.col("__total")))
    return drawn.join(maybe_broadcast(placed), F.col("__u") == F.col("__pos"), "left").drop("__u", "__pos", "__total")


def smote(df: DataFrame, key: str, label: str, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """All rows and made-up rows that bring every class to the size of the largest.

    A new row lies between a row of its class and one of that row's k nearest class
    neighbours. Every row of a class gives its share of the new rows, so the work is
    spread over the class; neighbours come from the exact blocked join.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).collect()  # one row per class
    top = max(r["n"] for r in sizes)
    out = df.select(F.col(key).alias("source"), label, *features, F.lit(0).cast("bigint").alias("copy"))
    for r in sizes:
        need, n = top - r["n"], r["n"]
        if need == 0 or n < 2:
            continue
        part = df.where(F.col(label) == r[label])
        points = part.select(F.col(key).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
        near = knn_join(points, points, min(k, n - 1), skip_same=True)
        ranked = hash_ranks(points.withColumn("__h", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))))), [], "__h", "__r")
        # need = whole copies per row, and one more for the first rows in hash order
        copies = (F.lit(need // n) + (F.col("__r") < need % n).cast("int")).cast("int")
        born = ranked.where(copies >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        pick = (F.floor(uniform("id", "copy", seed=seed) * min(k, n - 1)) + 1).cast("int")
        chosen = born.withColumn("rank", pick).join(near.select(F.col("qid").alias("id"), "pid", "rank"), ["id", "rank"])
        other = points.select(F.col("id").alias("pid"), F.col("v").alias("w"))
        u = uniform("id", "copy", seed=seed + 1)
        mixed = chosen.join(other, "pid").withColumn("u", u)
        new = mixed.select(
            F.col("id").alias("source"), F.lit(r[label]).alias(label),
            *[(F.col("v")[i] + F.col("u") * (F.col("w")[i] - F.col("v")[i])).alias(c) for i, c in enumerate(features)],
            F.col("copy").cast("bigint").alias("copy"))
        out = out.unionByName(new)
    return out
