"""Tree contributions against the definition of the Shapley value."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabloom.operators import explain, models, treeshap
from tabloom.operators.treeshap import Node, Trees


def expectation(tree, x, known, at=0):
    n = tree[at]
    if n.left < 0:
        return n.value
    if n.feature in known:
        left = x[n.feature] in n.categories if n.categories is not None else x[n.feature] <= n.threshold
        return expectation(tree, x, known, n.left if left else n.right)
    a, b = tree[n.left].weight, tree[n.right].weight
    return (a * expectation(tree, x, known, n.left) + b * expectation(tree, x, known, n.right)) / (a + b)


def by_definition(tree, x):
    d = len(x)
    out = []
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        total = 0
        for k in range(d):
            for s in itertools.combinations(rest, k):
                w = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                total = total + w * (expectation(tree, x, {*s, i}) - expectation(tree, x, set(s)))
        out.append(total)
    return np.array(out)  # (features, outputs)


def random_tree(rng, d, depth, outputs=1):
    tree = {}

    def grow(at, left):
        if left == 0 or rng.random() < 0.15:
            tree[at] = Node(float(rng.integers(1, 50)), rng.normal(size=outputs))
        else:
            a, b = len(tree) + 1, None
            tree[at] = None
            grow(a, left - 1)
            b = max(tree) + 1
            grow(b, left - 1)
            j = int(rng.integers(d))
            categories = frozenset(rng.permutation(4)[:2].astype(float).tolist()) if j == 0 else None
            tree[at] = Node(tree[a].weight + tree[b].weight, np.zeros(outputs), a, b, j, float(rng.integers(4)), categories)

    grow(0, depth)
    return tree


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_definition(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 6))
    tree = random_tree(rng, d, 6, 2)
    x = rng.integers(0, 5, (9, d)).astype(float)
    trees = Trees.given([tree])
    for output in (0, 1):
        got = trees.shapley(x, output)
        assert np.allclose(got, [by_definition(tree, row)[:, output] for row in x], atol=1e-12)


def test_blocks_of_leaves_and_sides_without_weight(monkeypatch):
    monkeypatch.setattr(treeshap, "CELLS", 7)
    tree = {0: Node(4, np.zeros(1), 1, 2, 0, 1.0), 1: Node(0, np.array([5.0])), 2: Node(4, np.zeros(1), 3, 4, 1, 1.0), 3: Node(1, np.array([2.0])), 4: Node(3, np.array([-1.0]))}
    x = np.array([[0.0, 0.0], [2.0, 2.0], [2.0, 0.0]])
    got = Trees.given([tree]).shapley(x, 0)
    assert np.allclose(got, [by_definition(tree, r)[:, 0] for r in x], atol=1e-12)


@pytest.fixture(scope="module")
def table(spark):
    t = spark.range(1200).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)) / 10).alias(f"x{k}") for k in range(6)])
    y = F.col("x0") * F.col("x1") - F.when(F.col("x2") > 5, 20.0).otherwise(F.col("x3"))
    label = F.when(y > 20, 2.0).when(y > 5, 1.0).otherwise(0.0)
    return t.select("id", y.alias("y"), label.alias("class"), array_to_vector(F.array(*[f"x{k}" for k in range(6)])).alias("features")).persist()


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "classes", "class_tree", "margin"])
def test_additive(spark, table, kind):
    up = (F.col("y") > 5).cast("double")
    make, label, output = {
        "tree": (DecisionTreeRegressor(maxDepth=9), F.col("y"), F.col("prediction")),
        "forest": (RandomForestRegressor(numTrees=15, maxDepth=8, seed=1), F.col("y"), F.col("prediction")),
        "boosted": (GBTRegressor(maxIter=8, maxDepth=4, seed=1), F.col("y"), F.col("prediction")),
        "classes": (RandomForestClassifier(numTrees=10, maxDepth=7, seed=1), F.col("class"), vector_to_array("probability")[2]),
        "class_tree": (DecisionTreeClassifier(maxDepth=6), F.col("class"), vector_to_array("probability")[2]),
        # Spark's own margin of a boosted classifier counts both sides, so the sum of its trees is half of the difference
        "margin": (GBTClassifier(maxIter=5, maxDepth=3, seed=1), up, (vector_to_array("rawPrediction")[1] - vector_to_array("rawPrediction")[0]) / 2),
    }[kind]
    model = make.fit(table.select("id", label.alias("label"), "features"))
    trees = Trees.of(model, spark)
    which = 2 if kind in ("classes", "class_tree") else 0
    phi = explain.tree_shap(table, trees, [f"x{k}" for k in range(6)], which)
    sums = phi.groupBy("id").agg(F.sum("shap_value").alias("s"), F.count("*").alias("n"))
    both = model.transform(table.select("id", "features")).select("id", output.alias("f")).join(sums, "id").collect()
    assert len(both) == 1200 and all(r.n == 6 for r in both)
    assert max(abs(r.f - r.s - trees.expected[which]) for r in both) < 1e-9


def test_a_forest_equals_the_definition(spark, table):
    model = RandomForestRegressor(numTrees=3, maxDepth=4, seed=2).fit(table.select("id", F.col("y").alias("label"), "features"))
    trees = Trees.of(model, spark)
    rows = table.limit(5).select("id", vector_to_array("features").alias("x")).collect()
    # the same value by listing all sets over the flat paths
    for r in rows:
        x = np.array(r.x)

        def value(known):
            own = (x[trees.feature] > trees.low) & (x[trees.feature] <= trees.high)
            free = ~np.isin(trees.feature, list(known))
            return (np.where(free, trees.share, own).prod(axis=1) * trees.value[:, 0]).sum()

        want = np.zeros(6)
        for i in range(6):
            rest = [j for j in range(6) if j != i]
            for k in range(6):
                for s in itertools.combinations(rest, k):
                    want[i] += math.factorial(k) * math.factorial(5 - k) / math.factorial(6) * (value({*s, i}) - value(set(s)))
        assert np.allclose(trees.shapley(x[None, :], 0)[0], want, atol=1e-9)


def test_dispatch(spark, table):
    names = [f"x{k}" for k in range(6)]
    t = table.select("id", F.col("y").alias("label"), "features")
    tree = models.fit_tree_regressor(t, {"max_depth": 4})
    exact = explain.shap_values(tree, t.limit(20), names, F.col("prediction"))
    assert exact.count() == 120
    # the contributions of a linear model are exact whatever permutations are drawn, but for the rows compared with
    line = models.fit_linear(t, {})
    few = t.where("id < 40")
    got = explain.shap_values(line, few, names, F.col("prediction")).groupBy("feature").agg(F.avg("shap_value").alias("m")).collect()
    assert len(got) == 6
