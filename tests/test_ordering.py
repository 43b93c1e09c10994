"""The spread paths must give what the plain window gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions import ordering as o
from tabloom.functions import quantiles
from tabloom.functions.quantiles import column_quantiles, exact_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    # one key holds most rows
    return spark.range(1000).select(
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("k"), F.col("id") % 4)).otherwise("hot").alias("k"),
        F.col("id").alias("t"),
        F.when(F.col("id") % 3 != 0, (F.col("id") * 7919 % 101).cast("double")).alias("v"),
    ).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(map(str, a.select(cols).collect()))
    assert left == sorted(map(str, b.select(cols).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
def test_positions(rows, keys):
    same(o.row_positions(rows, keys, ["t"]), o.row_positions(rows, keys, ["t"], max_rows=10))


@pytest.mark.parametrize("limit", [7, 40])
def test_framed(rows, limit):
    def build(w):
        return {
            "lag3": F.lag("v", 3).over(w),
            "roll": F.sum("v").over(w.rowsBetween(-4, 0)),
            "lead2": F.lead("v", 2).over(w),
        }
    same(o.framed(rows, ["k"], ["t"], 4, 2, build), o.framed(rows, ["k"], ["t"], 4, 2, build, max_rows=limit))


@pytest.mark.parametrize("forward", [True, False])
def test_carried(rows, forward):
    v = {"f": F.col("v"), "s": F.when(F.col("v").isNotNull(), F.struct("t", "v"))}
    same(o.carried(rows, ["k"], ["t"], v, forward), o.carried(rows, ["k"], ["t"], v, forward, max_rows=9))


def test_running_totals(rows):
    s = {"c": F.coalesce("v", F.lit(0.0))}
    same(o.running_totals(rows, ["k"], ["t"], s), o.running_totals(rows, ["k"], ["t"], s, max_rows=9))


def test_hash_ranks(rows):
    h = rows.withColumn("h", F.md5(F.col("t").cast("string")))
    same(o.hash_ranks(h, ["k"], "h"), o.hash_ranks(h, ["k"], "h", max_rows=20))


def test_quantile_brackets(rows):
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    a = exact_quantiles(rows, ["k"], "v", probs)
    b = exact_quantiles(rows, ["k"], "v", probs, direct_rows=20)
    same(a, b)
    big = rows.sparkSession.range(20000).select((F.col("id") * 104729 % 19997 / 7).alias("x"), F.lit(2.0).alias("y"))
    exact = column_quantiles(big, ["x", "y"], [0.25, 0.5, 0.9])
    narrow = column_quantiles(big, ["x", "y"], [0.25, 0.5, 0.9], direct_rows=200, small_rows=10)
    probed = column_quantiles(big, ["x", "y"], [0.25, 0.5, 0.9], small_rows=10)
    for c in exact:
        assert exact[c] == pytest.approx(narrow[c])
        assert exact[c] == pytest.approx(probed[c])


def test_large_tables_are_bracketed_without_rows_per_rank(spark, monkeypatch):
    """Above the medium size every column gets a few scans of its own; the joins of all values with all ranks are not used."""
    x = F.xxhash64("id") % 1_000_003
    df = spark.range(30_000).select(
        x.cast("double").alias("a"), F.pow(F.lit(10.0), x % 40).alias("b"), (F.col("id") % 3).alias("c"), F.when(x > 0, F.exp(x / 50_000)).alias("d"),
        F.lit(None).cast("double").alias("e"), F.when(F.col("id") < 15_000, x % 5_000 * 1e-3).otherwise(1e9 + x % 5_000).alias("f"))
    probs = [0.0, 0.01, 0.5, 0.75, 1.0]
    want = quantiles._direct_columns(df, df.columns, probs)
    assert quantiles.column_quantiles(df, df.columns, probs, direct_rows=2_000, small_rows=10) == want
    assert quantiles.column_quantiles(df, df.columns, probs, direct_rows=100, small_rows=10) == want
    monkeypatch.setattr(quantiles, "_by_brackets", None)
    columns = ["a", "b", "c", "d", "e"]
    assert quantiles.column_quantiles(df, columns, probs, direct_rows=200, small_rows=10) == {c: want[c] for c in columns}
