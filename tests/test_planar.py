"""Silhouettes through squares of the plane against all pairs."""

import numpy as np
import pandas as pd
import pytest

from tabloom.operators import cluster, planar
from tests.test_cluster import brute_silhouette


@pytest.fixture(scope="module")
def plane():
    rng = np.random.default_rng(8)
    parts = [rng.normal(0, 1, (700, 2)), rng.normal(3, 0.001, (500, 2)), rng.lognormal(0, 2, (200, 2)), np.full((90, 2), 5.0)]
    return np.concatenate(parts)


def labelled(spark, x, labels):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist(), "labels": labels.tolist()}), "id bigint, v array<double>, labels array<int>")


@pytest.mark.parametrize("columns", [1, 2])
def test_squares_of_any_size_give_the_sums_of_all_pairs(spark, plane, columns, monkeypatch):
    monkeypatch.setattr(cluster, "label_distance_sums", None)  # the pairs of blocks
    x = plane[:, :columns]
    i = np.arange(len(x))
    labels = np.stack([i % 4 - 1, np.where(i == 3, 2, (x[:, 0] > 1).astype(int)), np.zeros(len(x), dtype=int)], axis=1)
    p = labelled(spark, x, labels)
    sizes = [(j, int(c), int((labels[:, j] == c).sum())) for j in range(3) for c in set(labels[:, j]) - {-1}]
    got = {r["labeling"]: r["silhouette"] for r in planar.silhouettes(p, 3, sizes, 40).collect()}
    assert set(got) == {0, 1}
    for j in got:
        assert got[j] == pytest.approx(brute_silhouette(x, labels[:, j]), abs=1e-10)
    whole = {r["labeling"]: r["silhouette"] for r in cluster.silhouette(p, 3, 100).collect()}
    assert whole == pytest.approx(got, abs=1e-10)


def test_other_rows_are_left_to_the_pairs(spark, plane):
    labels = np.arange(len(plane))[:, None] % 2
    sizes = [(0, 0, 745), (0, 1, 745)]
    assert planar.silhouettes(labelled(spark, np.where(plane == 5, np.nan, plane), labels), 1, sizes) is None
    assert planar.silhouettes(labelled(spark, np.concatenate([plane, plane], axis=1), labels), 1, sizes) is None
    p = labelled(spark, plane, labels)
    assert planar.silhouettes(p.selectExpr("id div 2 as id", "v", "labels"), 1, sizes) is None
