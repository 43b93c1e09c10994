"""Exact Shapley values of tree models, from their node tables.

The value of a set of features is the path-dependent expectation: a split on a known feature is followed, any other one
is averaged over both sides by their training weight. A leaf then contributes a product over the features of its path,
z (the share of weight that takes the path's side) for an absent feature and o (1 if the row takes it, else 0) for a
present one. Its Shapley value for feature i is value * (o - z) * integral over t in [0, 1] of the product over the path's
other features of z * (1 - t) + o * t. That is a polynomial in t, so a Gauss-Legendre rule of half as many points as the
path has features is exact, and all leaves and a batch of rows are one array computation.

A deep forest of few features has far more leaves than bins. There the value of every set of features is tabulated over the
bins of the set, from the corners of all leaves, and looked up per row; the values follow from their definition over all sets.
A task does one tree, so the forest is never gathered, and the work does not grow with rows times leaves.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.forest import Branch, Crown, DeepForest, cells_of, leaf, outputs_of
from tabloom.session import scratch

#: Array cells a task computes at once.
CELLS = 1 << 21
FEW_FEATURES = 8  # up to which all sets of features are valued
TABLE_CELLS = 2_000_000  # of a set's table; larger sets follow every row down the tree, where few of its features are unknown
BLOCK_ROWS = 200_000  # different rows a task explains by one tree
PART_ROWS = 20_000  # rows whose contributions are summed over the trees in one task
_LEAST = 1e-300  # stands for a side without weight, which a quotient must not divide by


@dataclass
class Node:
    """One node of a tree; a leaf has no children. A split on a category has the set of categories that go left."""

    weight: float
    value: np.ndarray
    left: int = -1
    right: int = -1
    feature: int = -1
    threshold: float = 0.0
    categories: frozenset[float] | None = None


@dataclass
class Trees:
    """Leaves of all trees of a model as flat tables; a path has one place per different feature, unused places are neutral."""

    feature: np.ndarray  # (leaves, places)
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray  # (leaves, outputs)
    expected: np.ndarray  # (outputs,)
    category: list[tuple[int, int, np.ndarray]]  # (leaf, place, allowed categories)

    @classmethod
    def given(cls, trees: list[dict[int, Node]], scales: list[float] | None = None) -> Trees:
        """From node tables by node number, with the root numbered 0. Outputs of the trees are scaled and added."""
        rows: list[tuple[dict, np.ndarray]] = []
        expected = np.zeros(len(trees[0][0].value))
        for tree, scale in zip(trees, scales or [1.0] * len(trees)):
            stack: list[tuple[int, dict]] = [(0, {})]
            root = tree[0].weight
            while stack:
                at, path = stack.pop()
                node = tree[at]
                if node.left < 0:
                    rows.append((path, scale * node.value))
                    expected = expected + scale * node.value * (node.weight / root if root else 0.0)
                    continue
                for child, goes_left in ((node.left, True), (node.right, False)):
                    low, high, share, allowed = path.get(node.feature, (-np.inf, np.inf, 1.0, None))
                    share *= tree[child].weight / node.weight if node.weight else 0.0
                    if node.categories is not None:
                        side = (node.categories, True) if goes_left else (node.categories, False)
                        allowed = [*(allowed or []), side]
                    elif goes_left:
                        high = min(high, node.threshold)
                    else:
                        low = max(low, node.threshold)
                    stack.append((child, {**path, node.feature: (low, high, share, allowed)}))
        places = max(1, max(len(p) for p, _ in rows))
        shape = (len(rows), places)
        out = cls(np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.array([v for _, v in rows]), expected, [])
        for i, (path, _) in enumerate(rows):
            for j, (feature, (low, high, share, allowed)) in enumerate(path.items()):
                out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = feature, low, high, max(share, _LEAST)
                if allowed:
                    out.category.append((i, j, allowed))
        return out

    @classmethod
    def of(cls, model, spark) -> Trees:
        """From a fitted Spark tree, forest or boosted ensemble, through its saved node table.

        A classifier's outputs are its class probabilities; a boosted one's single output is the margin.
        """
        if isinstance(model, DeepForest):
            return cls.given([_nodes(model, *t) for t in model.tables()], [1.0 / len(model.crowns)] * len(model.crowns))
        path = scratch(spark, "trees")
        model.write().save(path)
        saved = spark.read.parquet(f"{path}/data")
        node = F.col("nodeData") if "nodeData" in saved.columns else F.struct(*saved.columns)
        tree = F.col("treeID") if "treeID" in saved.columns else F.lit(0)
        kept = ("id", "prediction", "impurityStats", "leftChild", "rightChild", "split")
        rows = saved.select(tree.alias("tree"), *[node[c].alias(c) for c in kept]).toArrow().to_pylist()  # as large as the model
        scales = [float(w) for w in getattr(model, "treeWeights", [1.0])]
        boosted = type(model).__name__.startswith("GBT")
        classes = hasattr(model, "numClasses") and not boosted
        if not boosted:
            scales = [1.0 / len(scales)] * len(scales)
        trees: list[dict[int, Node]] = [{} for _ in scales]
        for r in rows:
            stats, split = np.array(r["impurityStats"]), r["split"]
            weight = float(stats.sum() if classes else stats[0])
            value = stats / weight if classes else np.array([r["prediction"]])
            n = Node(weight, value, r["leftChild"], r["rightChild"], split["featureIndex"])
            if n.left >= 0:
                if split["numCategories"] >= 0:
                    n.categories = frozenset(split["leftCategoriesOrThreshold"])
                else:
                    n.threshold = split["leftCategoriesOrThreshold"][0]
            trees[r["tree"]][r["id"]] = n
        return cls.given(trees, scales)

    def shapley(self, x: np.ndarray, output: int) -> np.ndarray:
        """Values (rows, features) of one output for rows of features."""
        phi = np.zeros(x.shape)
        places = self.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss((places + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        step = max(1, CELLS // (len(x) * places or 1))
        for a in range(0, len(self.feature), step):
            f = self.feature[a : a + step]
            seen = x[:, f]
            own = (seen > self.low[a : a + step]) & (seen <= self.high[a : a + step])
            for leaf, place, sides in self.category:
                if a <= leaf < a + step:
                    for left, inside in sides:
                        own[:, leaf - a, place] &= np.isin(seen[:, leaf - a, place], list(left)) == inside
            z, o = self.share[a : a + step], own.astype(float)
            total = np.zeros(o.shape)
            for t, w in zip(points, weights):
                part = z * (1 - t) + o * t
                total += w * part.prod(axis=2, keepdims=True) / part
            change = (o - z) * total * self.value[a : a + step, output][None, :, None]
            for j in np.unique(f):
                phi[:, j] += change[:, f == j].sum(axis=1)
        return phi


def _nodes(model: DeepForest, crown: Crown, branches: dict[int, Branch]) -> dict[int, Node]:
    """One node table of a tree: its upper nodes, and its branches in place of their ends."""
    nodes: dict[int, Node] = {}

    def add(branch: Branch, names: list[int]) -> None:
        values = outputs_of(branch.totals, model.std, model.mean, model.classes)
        for i, at in enumerate(names):
            n = nodes[at] = Node(float(branch.totals[i, 0]), values[i])
            if branch.feature[i] >= 0:
                f, child = int(branch.feature[i]), branch.left[i]
                cuts = model.cuts[f]
                n.left, n.right, n.feature = names[child], names[child + 1], f
                n.threshold = float(cuts[branch.cut[i]]) if branch.cut[i] < len(cuts) else np.inf

    free = len(crown.code)
    for at, f in enumerate(crown.feature):
        if f < 0:
            branch = branches.get(at) or leaf(model.overall)
            add(branch, [at, *range(free, free + len(branch.feature) - 1)])
            free += len(branch.feature) - 1
    for at in reversed(range(len(crown.code))):
        if crown.feature[at] >= 0:
            a = crown.left[at]
            totals = np.array([crown.totals[at]])
            nodes[at] = Node(float(totals[0, 0]), outputs_of(totals, model.std, model.mean, model.classes)[0], a, a + 1,
                             crown.feature[at], float(model.cuts[crown.feature[at]][crown.cut[at]]))
    return nodes


@dataclass
class FlatTree:
    """A tree as arrays over its nodes; the right child follows the left one, a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray  # of the parent's weight
    value: np.ndarray
    bins: list[int]  # of every feature

    @classmethod
    def of(cls, crown: Crown, branches: dict[int, Branch], overall: list[float], std: float, mean: float, classes: int, output: int, bins: list[int]) -> FlatTree:
        parts = [np.array(crown.feature), np.array(crown.cut), np.array(crown.left), np.zeros(len(crown.code)), np.zeros(len(crown.code))]
        more, free = [], len(crown.code)
        for at, f in enumerate(crown.feature):
            if f >= 0:
                parts[3][at] = crown.totals[at][0]
                continue
            b = branches.get(at) or leaf(overall)
            left = np.where(b.feature >= 0, b.left + free - 1, -1)
            held = (b.feature, b.cut, left, b.totals[:, 0], outputs_of(b.totals, std, mean, classes)[:, output])
            for whole, p in zip(parts, held):
                whole[at] = p[0]
            more.append([p[1:] for p in held])
            free += len(b.feature) - 1
        feature, cut, left, weight, value = (np.concatenate([p.astype(k), *[m[i] for m in more]]).astype(k)
                                             for i, (p, k) in enumerate(zip(parts, (int, int, int, float, float))))
        share, inner = np.ones(len(feature)), np.flatnonzero(feature >= 0)
        for child in (left[inner], left[inner] + 1):
            share[child] = np.divide(weight[child], weight[inner], out=np.zeros(len(inner)), where=weight[inner] > 0)
        return cls(feature, cut, left, share, value, bins)

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every leaf: its bins from low to below high and its share of weight by feature, and its value."""
        d = len(self.bins)
        at, low, high, share = np.array([0]), np.zeros((1, d), dtype=int), np.array([self.bins]), np.ones((1, d))
        out = []
        while len(at):
            f = self.feature[at]
            end = f < 0
            out.append((low[end], high[end], share[end], self.value[at[end]]))
            at, f, low, high, share = at[~end], f[~end], low[~end], high[~end], share[~end]
            rows, edge, left = np.arange(len(at)), self.cut[at] + 1, self.left[at]
            sides = []
            for child, cap in ((left, True), (left + 1, False)):
                lo, hi, z = low.copy(), high.copy(), share.copy()
                if cap:
                    hi[rows, f] = np.minimum(hi[rows, f], edge)
                else:
                    lo[rows, f] = np.maximum(lo[rows, f], edge)
                z[rows, f] *= self.share[child]
                sides.append((child, lo, hi, z))
            at, low, high, share = (np.concatenate(p) for p in zip(*sides))
        return tuple(np.concatenate(p) for p in zip(*out))

    def followed(self, x: np.ndarray, known: tuple[int, ...]) -> np.ndarray:
        """The value of a set of known features per row: other features' splits are averaged on the way down."""
        member = np.zeros(len(self.bins) + 1, dtype=bool)
        member[list(known)] = True
        out = np.zeros(len(x))
        for a in range(0, len(x), 1024):
            part = x[a:a + 1024]
            u, at, w = np.arange(len(part)), np.zeros(len(part), dtype=int), np.ones(len(part))
            while len(u):
                f = self.feature[at]
                end = f < 0
                out[a:a + 1024] += np.bincount(u[end], w[end] * self.value[at[end]], len(part))
                u, at, w, f = u[~end], at[~end], w[~end], f[~end]
                sure = member[f]
                one = self.left[at[sure]] + (part[u[sure], f[sure]] > self.cut[at[sure]])
                two = self.left[at[~sure]]
                u, w = np.concatenate([u[sure], u[~sure], u[~sure]]), np.concatenate([w[sure], w[~sure] * self.share[two], w[~sure] * self.share[two + 1]])
                at = np.concatenate([one, two, two + 1])
        return out

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Values (rows, features) for rows of bins, by their definition over all sets of features."""
        d = len(self.bins)
        phi, x = np.zeros((len(x), d)), x.astype(int)
        low, high, share, value = self.boxes()
        part = [factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)]
        for k in range(d + 1):
            for known in combinations(range(d), k):
                sizes = [self.bins[f] + 1 for f in known]
                cols = list(known)
                cells = int(np.prod(sizes))
                if cells > TABLE_CELLS or k == d:
                    v = self.followed(x, known)
                else:
                    w = value * share[:, [f for f in range(d) if f not in known]].prod(axis=1)
                    w = w * (low[:, cols] < high[:, cols]).all(axis=1)
                    strides = np.array([int(np.prod(sizes[i + 1:])) for i in range(k)], dtype=int)
                    table = np.zeros(cells)
                    for side in product((0, 1), repeat=k):
                        corner = np.where(np.array(side, dtype=bool), high[:, cols], low[:, cols]) @ strides
                        table += np.bincount(corner.astype(int), w * (-1) ** sum(side), cells)
                    table = table.reshape(sizes)
                    for axis in range(k):
                        np.cumsum(table, axis=axis, out=table)
                    v = table.ravel()[(x[:, cols] @ strides).astype(int)]
                for f in range(d):
                    phi[:, f] += v * (part[k - 1] if f in known else -part[k])
        return phi


def forest_shap(df: DataFrame, model: DeepForest, names: list[str], output: int) -> DataFrame:
    """`tree_shap` of a deep forest: rows in the same bins are explained once, a tree a task."""
    spark, d, trees = df.sparkSession, len(model.cuts), len(model.crowns)
    bins = [len(c) + 1 for c in model.cuts]
    rows = df.select("id", vector_to_array("features").alias("x")).withColumn("c", cells_of(model.cuts)("x"))
    cells = rows.select("c").distinct()
    blocks = -(-cells.count() // BLOCK_ROWS) or 1
    sent = spark.sparkContext.broadcast(model.crowns)
    std, mean, classes, overall = model.std, model.mean, model.classes, model.overall

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [b["block"].iloc[0]], "cells": [b"".join(sorted(b["c"]))]})

    held = cells.withColumn("block", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(packed, "block int, cells binary")
    each = held.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    grown = model.branches.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def explained(b: pd.DataFrame, branch: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"block": [], "part": [], "tree": [], "cells": [], "phi": []}
        if len(b):
            t, block = int(b["tree"].iloc[0]), int(b["block"].iloc[0])
            tree = FlatTree.of(sent.value[t], {p: Branch.of(bytes(h)) for p, h in zip(branch["place"], branch["branch"])}, overall, std, mean, classes, output, bins)
            x = np.frombuffer(b["cells"].iloc[0], np.uint8).reshape(-1, d)
            phi = tree.shapley(x)
            for a in range(0, len(x), PART_ROWS):
                for name, v in (("block", block), ("part", a), ("tree", t), ("cells", b"" if t else x[a:a + PART_ROWS].tobytes()), ("phi", phi[a:a + PART_ROWS].tobytes())):
                    out[name].append(v)
        return pd.DataFrame(out)

    def summed(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("tree")  # the sums do not hang on the order of arrival
        total = sum(np.frombuffer(v) for v in b["phi"]).reshape(-1, d) / trees
        whole = b["cells"].iloc[0]
        return pd.DataFrame({"c": [whole[i:i + d] for i in range(0, len(whole), d)], "phi": list(total)})

    tasks = min(trees * blocks, max(4 * spark.sparkContext.defaultParallelism, trees * blocks // 32))
    # told by number, the tasks are not merged for their few bytes: their work is far larger
    met = each.repartition(tasks, "tree", "block").groupBy("tree", "block").cogroup(
        grown.repartition(tasks, "tree", "block").groupBy("tree", "block")).applyInPandas(explained, "block int, part int, tree int, cells binary, phi binary")
    phi = met.groupBy("block", "part").applyInPandas(summed, "c binary, phi array<double>")
    return _long(rows.join(phi, "c"), names)


def tree_shap(df: DataFrame, trees: Trees, names: list[str], output: int = 0, features: Column | None = None) -> DataFrame:
    """(id, feature, value, shap_value): exact contributions of every feature to one output, a pass without shuffles.

    The values of a row add up to the model's output minus `trees.expected[output]`. `features` is an array column; by
    default the vector column of that name.
    """

    @F.pandas_udf("array<double>")
    def values(v: pd.Series) -> pd.Series:
        rows = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
        parts = [trees.shapley(rows[k : k + 512], output) for k in range(0, len(rows), 512)]
        return pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    x = vector_to_array("features") if features is None else features
    return _long(df.select("id", x.alias("x")).withColumn("phi", values("x")), names)


def _long(rows: DataFrame, names: list[str]) -> DataFrame:
    cells = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("x").alias("value"), F.col("phi").alias("shap_value"))
    return rows.select("id", F.explode(cells).alias("c")).select("id", F.col("c.feature").alias("feature"), F.col("c.value").alias("value"), F.col("c.shap_value").alias("shap_value"))


def weighed(nodes: dict[int, Node], df: DataFrame, features: list[str]) -> dict[int, Node]:
    """A given tree with the number of rows of `df` that reach each node as its weight; one aggregate."""
    reached: dict[int, Column] = {0: F.lit(True)}
    stack = [0]
    while stack:
        at = stack.pop()
        n = nodes[at]
        if n.left >= 0:
            left = F.col(features[n.feature]) <= n.threshold if n.categories is None else F.col(features[n.feature]).isin(*n.categories)
            left = F.coalesce(left, F.lit(False))
            reached[n.left], reached[n.right] = reached[at] & left, reached[at] & ~left
            stack += [n.left, n.right]
    counts = df.agg(*[F.count_if(c).alias(f"n{k}") for k, c in reached.items()]).first()
    return {k: Node(float(counts[f"n{k}"]), n.value, n.left, n.right, n.feature, n.threshold, n.categories) for k, n in nodes.items()}
