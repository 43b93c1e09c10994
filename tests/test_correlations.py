"""One-pass correlations against numpy, pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile


def expected(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if not len(a) or a.std() == 0 or b.std() == 0:
        return None
    return float(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))


@pytest.mark.parametrize("count,block,parts", [(5, 64, 1), (7, 3, 6), (70, 64, 3)])
def test_pairwise_complete(spark, monkeypatch, count, block, parts):
    monkeypatch.setattr(profile, "CORR_BLOCK", block)
    rng = np.random.default_rng(count)
    x = rng.normal(size=(400, count)).cumsum(axis=1) + 1e6 * rng.integers(0, 3, count)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 1] = 7.25  # constant
    x[:, 2] = np.nan  # never there
    x[:200, 3], x[200:, 4] = np.nan, np.nan  # never together
    names = [f"c {k}." for k in range(count)]
    rows = [tuple(None if np.isnan(v) and r % 2 else float(v) for v in row) for r, row in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(parts)
    got = {(r.a, r.b): r["corr"] for r in profile.correlation_matrix(df).collect()}
    assert len(got) == count * count
    for i in range(count):
        for j in range(count):
            want = expected(x, i, j)
            assert got[names[i], names[j]] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_constant_beside_another_column_and_empty_parts(spark):
    rows = [(0.1, 1.0), (0.1, 2.0), (0.1, 5.0), (9.0, None)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(8)
    got = {(r.a, r.b): r["corr"] for r in profile.correlation_matrix(df).collect()}
    assert got["a", "b"] is None and got["a", "a"] == pytest.approx(1) and got["b", "b"] == pytest.approx(1)
    assert profile.correlation_matrix(df.select("a")).collect() == []
    assert {r["corr"] for r in profile.correlation_matrix(df.where("a > 99")).collect()} == {None}


def test_one_scan(spark):
    df = spark.range(10).select(*[(F.col("id") * k % 7).alias(f"x{k}") for k in range(40)])
    plan = profile.correlation_matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 10,") == 1
