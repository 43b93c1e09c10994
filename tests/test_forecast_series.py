"""Series are fitted each by itself, whatever else the table holds."""

import datetime

import numpy as np
import pytest

from tabloom.operators import cluster
from tabloom.operators import forecast as fc
from tabloom.sources import delimited

START = datetime.datetime(2020, 1, 1)


def series(spark, lengths, step=datetime.timedelta(hours=1)):
    rows = []
    for name, n in lengths.items():
        rng = np.random.default_rng(len(name) + n)
        y = 0.0
        for i in range(n):
            y = 0.6 * y + rng.normal()
            rows.append((name, START + i * step, float(y)))
    return spark.createDataFrame(rows, "series string, ts timestamp, y double")


def test_a_long_series_leaves_the_others_alone(spark):
    short = {r.series: r for r in fc.adf_order(series(spark, {"a": 25, "b": 80}), ["series"], "ts", "y").collect()}
    both = {r.series: r for r in fc.adf_order(series(spark, {"a": 25, "b": 80, "long": 3000}), ["series"], "ts", "y").collect()}
    assert set(both) == {"a", "b", "long"}
    for name in ("a", "b"):
        assert both[name].d == short[name].d and both[name].lag0 == short[name].lag0
        assert both[name].stat0 == pytest.approx(short[name].stat0, rel=1e-9)


def test_no_series_is_lost(spark):
    t = series(spark, {"tiny": 3, "a": 14, "b": 80})
    assert {r.series for r in fc.adf_order(t, ["series"], "ts", "y").collect()} == {"tiny", "a", "b"}
    assert {"a", "b"} <= {r.series for r in fc.with_innovations(fc.difference(t, ["series"], "ts", "y", None), ["series"], "ts").collect()}


def test_seasons_belong_to_their_series(spark):
    hourly = series(spark, {"hourly": 200})
    daily = series(spark, {"daily": 1200}, datetime.timedelta(days=1))
    flags = {r.series: r for r in fc.season_flags(hourly.union(daily), ["series"], "ts").collect()}
    assert (flags["hourly"]["__daily"], flags["hourly"]["__weekly"], flags["hourly"]["__yearly"]) == (True, False, False)
    assert (flags["daily"]["__daily"], flags["daily"]["__weekly"], flags["daily"]["__yearly"]) == (False, True, True)
    alone = fc.seasonal_fit(hourly, ["series"], "ts", "y").first()
    mixed = fc.seasonal_fit(hourly.union(daily), ["series"], "ts", "y").where("series = 'hourly'").first()
    assert mixed.sigma == pytest.approx(alone.sigma, rel=1e-6)
    assert sum(abs(np.array(mixed.coef)) > 1e-9) == sum(abs(np.array(alone.coef)) > 1e-9)


def test_dbscan_takes_many_columns(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.05, (30, 6)), rng.normal(3, 0.05, (40, 6)), [[9.0] * 6]])
    columns = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in columns))
    labels = {r.id: r.label for r in cluster.dbscan(df, "id", columns, 0.5, 5).collect()}
    assert [labels[i] for i in range(30)] == [0] * 30 and [labels[i] for i in range(30, 70)] == [1] * 40 and labels[70] == -1


def test_kmeans_starts_see_all_rows(spark):
    rows = [(i, [float(i % 3) * 100, 0.0]) for i in range(6000)] + [(9999, [1e4, 1e4])]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    inertia, centers = cluster.kmeans_runs(points, [4], 3)[4]
    assert inertia == pytest.approx(0, abs=1e-6) and max(c[0] for c in centers) == 1e4


def test_data_rows_equal_to_the_header_stay(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.txt").write_text("x y\n1 2\nx y\n3 4\n")
    (folder / "b.txt").write_text("x y\n5 6\n")
    rows = delimited.scan_whitespace_table(spark, str(folder)).collect()
    assert sorted((r.x, r.y) for r in rows) == [("1", "2"), ("3", "4"), ("5", "6"), ("x", "y")]
