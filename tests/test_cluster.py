"""Neighbours, silhouette and DBSCAN against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import cluster, neighbors


def points(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": [list(map(float, r)) for r in x]}), "id bigint, v array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(4, 0.5, (100, 3))])
    return np.concatenate([x, np.repeat(x[:1], 60, axis=0)])  # many copies of one row


def brute_knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return {i: [(j, round(d[i, j], 9)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]] for i in range(len(x))}


@pytest.mark.parametrize("small,block", [(10_000, 64), (10, 64), (10, 17)])
def test_knn(spark, cloud, small, block):
    p = points(spark, cloud)
    got = neighbors.knn_join(p, p, 4, skip_same=True, small_side=small, block_rows=block).orderBy("qid", "rank").toPandas()
    want = brute_knn(cloud, 4)
    for q, rows in got.groupby("qid"):
        assert [(a, round(b, 9)) for a, b in zip(rows["pid"], rows["distance"])] == want[q]
    assert got["qid"].nunique() == len(cloud)


def brute_silhouette(x, labels):
    keep = labels >= 0
    x, labels = x[keep], labels[keep]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_of_joined_points_in_blocks(spark, cloud):
    """Points and labels that come from one table, joined, as the queries join them."""
    x = cloud[:, :2]
    t = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    marks = t.select("id", F.array((F.col("a") > 2).cast("int")).alias("labels"))
    p = cluster.scaled_vectors(t, "id", ["a", "b"]).join(marks, "id")
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    got = cluster.silhouette(p, 1, 10, 50).first()["silhouette"]
    assert got == pytest.approx(brute_silhouette(scaled, (x[:, 0] > 2).astype(int)), abs=1e-9)


@pytest.mark.parametrize("small", [10_000, 10])
def test_silhouette(spark, cloud, small):
    labels = np.stack([np.arange(len(cloud)) % 3, (cloud[:, 0] > 2).astype(int) - (np.arange(len(cloud)) == 7)], axis=1)
    p = spark.createDataFrame(pd.DataFrame({"id": range(len(cloud)), "v": cloud.tolist(), "labels": labels.tolist()}),
                              "id bigint, v array<double>, labels array<int>")
    got = {r["labeling"]: r["silhouette"] for r in cluster.silhouette(p, 2, small, 50).collect()}
    for j in (0, 1):
        assert got[j] == pytest.approx(brute_silhouette(cloud, labels[:, j]), abs=1e-9)


def brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = d.sum(axis=1) >= m
    labels = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if not core[i] or labels[i] >= 0:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if labels[j] >= 0:
                continue
            labels[j] = c
            if core[j]:
                stack += [n for n in np.flatnonzero(d[j]) if labels[n] < 0]
        c += 1
    return labels.tolist()


@pytest.mark.parametrize("dims,eps", [(2, 0.3), (3, 0.8)])
def test_dbscan(spark, dims, eps):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.7, (200, dims)), rng.normal(3, 0.3, (120, dims)), rng.uniform(-3, 6, (80, dims)),
                        np.full((40, dims), 5.0)])
    x = x[rng.permutation(len(x))]
    cols = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(key=range(len(x))))
    got = cluster.dbscan(df, "key", cols, eps, 5).orderBy("key").toPandas()["label"].tolist()
    assert got == brute_dbscan(x, eps, 5)


def test_components_of_a_long_path_keep_a_small_plan(spark):
    """What the optimizer infers of a round must not be handed on: it doubled every round, and with it the time to plan."""
    node = lambda c: F.struct(F.lit(0).alias("kind"), F.col(c).alias("id"))
    t = spark.range(96).select((F.col("id") * 37 % 97).alias("i"), ((F.col("id") + 1) * 37 % 97).alias("j"))
    ids = t.select("i").union(t.select("j")).distinct()
    out = cluster._components(ids.select(node("i").alias("a"), F.col("i").alias("first")), t.select(node("i").alias("a"), node("j").alias("b")))
    assert out._jdf.queryExecution().analyzed().constraints().size() < 4
    assert [tuple(r) for r in out.select("first").distinct().collect()] == [(0,)] and out.count() == 97


def test_kmeans_sweep_finds_blobs(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(c, 0.5, (50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    table, centers = cluster.kmeans_sweep(points(spark, x), (2, 5), restarts=3, include_dbscan=False)
    best = table.where("best").first()
    assert best["model"] == "kmeans_3" and best["n_clusters"] == 3
    labels = np.array([((x[i] - centers[3]) ** 2).sum(axis=1).argmin() for i in range(len(x))])
    assert best["silhouette"] == pytest.approx(brute_silhouette(x, labels), abs=1e-9)


def test_a_pass_reads_packed_blocks_without_a_shuffle(spark):
    x = np.random.default_rng(3).normal(size=(500, 3))
    centers = {0: x[:2], 1: x[2:7], 2: x[7:9]}
    got = cluster._pass(cluster._blocks(points(spark, x)), centers)
    for r, c in centers.items():
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d2.argmin(axis=1)
        assert np.array_equal(got[r][0], np.bincount(own, minlength=len(c)))
        assert np.allclose(got[r][1], [x[own == j].sum(axis=0) for j in range(len(c))])
        assert got[r][2] == pytest.approx(d2.min(axis=1).sum())


def test_many_centers_are_measured_as_few_are(spark):
    x = np.random.default_rng(4).normal(size=(300, 2)).round(2)
    p = points(spark, x)
    both = p.select(cluster._closest(F.col("v"), x[:40]).alias("a"), cluster._nearest_of(x[:40])("v").alias("b"))
    assert both.where((F.col("a.d") != F.col("b.d")) | (F.col("a.i") != F.col("b.i"))).isEmpty()
