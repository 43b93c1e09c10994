"""Forests of deep trees, grown where their rows are.

Spark ML keeps dense counts of every node of a level in every task and all nodes on the driver. Here features are cut
into at most 32 bins once. The upper nodes of all trees, those with more than `NODE_ROWS` rows, are split from counts
summed over the tasks, a level a pass. A node with fewer rows is sent with its rows to one task, which grows the rest of
its branch. Branches stay a table: rows to be scored are sent to them by tree and node, and only votes are summed.
A row's weight in a tree and the features tried at a node are hashes, so neither depends on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import scratch

BINS = 32
NODE_ROWS = 50_000  # most rows of a node that one task grows to the end
CELLS = 200_000  # sums a task holds at once while it grows a level: few enough for its cache
SPARSE = 16  # a level with fewer rows a node is split from its sorted rows, not from counts of all bins
LEAST_GAIN = 1e-12  # of a split, per row, with labels of variance 1: below it is rounding
EQUAL_GAIN = 10  # decimals at which splits count as equally good, so that the first is taken whatever the order of the sums
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers (splitmix)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def drawn(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1."""
    u = _mixed(h.view(np.uint64) ^ _mixed(np.array([seed * 1_000_003 + tree]))[0]) >> np.uint64(11)
    return np.searchsorted(_POISSON, u * 2.0 ** -53).astype(float)


def tried(code: np.ndarray, tree: int, seed: int, d: int, m: int) -> np.ndarray:
    """(nodes, m): the features tried at each node."""
    if m >= d:
        return np.tile(np.arange(d), (len(code), 1))
    base = _mixed(np.array([seed * 7_000_003 + tree]))[0]
    ranks = _mixed(_mixed(code.astype(np.uint64) ^ base)[:, None] + np.arange(d, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(ranks, axis=1, kind="stable")[:, :m], axis=1)


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, place of the feature and bin of the best split of each node, from sums (nodes, features, bins, weight and values)."""
    left = sums.cumsum(axis=2)
    total = left[:, :1, -1:]
    left = left[:, :, :-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left[..., 1:] ** 2).sum(axis=-1) / left[..., 0] + (right[..., 1:] ** 2).sum(axis=-1) / right[..., 0]
    score[(left[..., 0] <= 0) | (right[..., 0] <= 0)] = -np.inf
    whole = total[:, 0, 0]
    weight = np.maximum(whole[:, :1], 1e-300)
    gain = (score.reshape(len(sums), -1) - (whole[:, 1:] ** 2).sum(axis=1, keepdims=True) / weight) / weight
    at = np.round(gain, EQUAL_GAIN).argmax(axis=1)
    return gain[np.arange(len(gain)), at], at // score.shape[2], at % score.shape[2]


def summed(key: np.ndarray, cells: np.ndarray, channels: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Sums of the channels by node, feature and bin; row i belongs to node key[i], whose features are feats[key[i]]."""
    n, m = feats.shape
    place = ((key[:, None] * m + np.arange(m)) * BINS + np.take_along_axis(cells, feats[key], axis=1)).ravel()
    out = np.empty((n * m * BINS, channels.shape[1]))
    for c in range(channels.shape[1]):
        out[:, c] = np.bincount(place, np.repeat(channels[:, c], m), n * m * BINS)
    return out.reshape(n, m, BINS, -1)


def sorted_splits(key: np.ndarray, cells: np.ndarray, channels: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`best_splits` of nodes with few rows each: running sums over the rows in the order of their bins."""
    n, m = feats.shape
    best, gain, which, cut = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=int)
    ends = np.bincount(key, minlength=n).cumsum()
    rows = np.arange(len(key))
    for j in range(m):
        b = cells[rows, feats[key, j]]
        order = np.argsort(key * BINS + b, kind="stable")
        node, b = key[order], b[order]
        run = np.concatenate([np.zeros((1, channels.shape[1])), channels[order].cumsum(axis=0)])
        base = run[np.concatenate([[0], ends[:-1]])]
        whole = run[ends] - base
        i = np.flatnonzero((node[1:] == node[:-1]) & (b[1:] != b[:-1]))
        if not len(i):
            continue
        owner = node[i]
        left = run[i + 1] - base[owner]
        right = whole[owner] - left
        none = (whole[:, 1:] ** 2).sum(axis=1) / whole[:, 0]
        score = (left[:, 1:] ** 2).sum(axis=1) / left[:, 0] + (right[:, 1:] ** 2).sum(axis=1) / right[:, 0]
        exact = (score - none[owner]) / whole[owner, 0]
        score = np.round(exact, EQUAL_GAIN)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(owner)))))
        hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
        hit = hit[score[hit] > best[owner[hit]]]
        best[owner[hit]], gain[owner[hit]], which[owner[hit]], cut[owner[hit]] = score[hit], exact[hit], j, b[i[hit]]
    return gain, which, cut


@dataclass
class Branch:
    """Nodes of a tree or of a part of it: the right child follows the left one, a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    totals: np.ndarray  # weight and values of every node
    gain: np.ndarray

    def bytes(self) -> bytes:
        head = np.array([len(self.feature), self.totals.shape[1]], dtype=np.int64).tobytes()
        return head + b"".join([self.feature.astype(np.int16).tobytes(), self.cut.astype(np.uint8).tobytes(),
                                self.left.astype(np.int32).tobytes(), self.totals.astype(float).tobytes(), self.gain.astype(float).tobytes()])

    @classmethod
    def of(cls, held: bytes) -> Branch:
        n, c = np.frombuffer(held, np.int64, 2)
        at, parts = 16, []
        for kind, width in ((np.int16, 1), (np.uint8, 1), (np.int32, 1), (float, c), (float, 1)):
            parts.append(np.frombuffer(held, kind, n * width, at))
            at += n * width * np.dtype(kind).itemsize
        parts[3] = parts[3].reshape(n, c)
        return cls(*parts)

    def ends(self, cells: np.ndarray) -> np.ndarray:
        """The leaf every row reaches."""
        at = np.zeros(len(cells), dtype=np.int64)
        rows = np.arange(len(cells))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            here = at[rows]
            at[rows] = self.left[here] + (cells[rows, self.feature[here]] > self.cut[here])
        return at


def leaf(totals: list[float]) -> Branch:
    return Branch(np.array([-1]), np.array([0]), np.array([-1]), np.array([totals]), np.zeros(1))


def grow(cells: np.ndarray, channels: np.ndarray, code: int, tree: int, seed: int, m: int, depth: int) -> Branch:
    """The whole branch below the node `code` (1 for a root, 2c and 2c + 1 below c), a level at a time."""
    d = cells.shape[1]
    cells = cells.astype(np.int64)
    feature, cut, left, totals, gains = [], [], [], [], []
    codes, key = np.array([code], dtype=np.int64), np.zeros(len(cells), dtype=np.int64)
    size = 1
    while len(codes):
        n = len(codes)
        f, c, child, gain = np.full(n, -1), np.zeros(n, dtype=int), np.full(n, -1), np.zeros(n)
        total = np.stack([np.bincount(key, channels[:, i], n) for i in range(channels.shape[1])], axis=1)
        if int(codes[0]).bit_length() - 1 < depth and len(key) < SPARSE * n:
            feats = tried(codes, tree, seed, d, m)
            got, which, at = sorted_splits(key, cells, channels, feats)
            good = np.flatnonzero(got > LEAST_GAIN)
            f[good], c[good], gain[good] = feats[good, which[good]], at[good], got[good] * total[good, 0]
        elif int(codes[0]).bit_length() - 1 < depth:
            step = max(1, CELLS // (m * BINS * channels.shape[1]))
            order = np.argsort(key, kind="stable")
            starts = np.searchsorted(key[order], np.arange(0, n + step, step))
            for a, (lo, hi) in zip(range(0, n, step), zip(starts[:-1], starts[1:])):
                rows = order[lo:hi]
                feats = tried(codes[a:a + step], tree, seed, d, m)
                got, which, at = best_splits(summed(key[rows] - a, cells[rows], channels[rows], feats))
                good = np.flatnonzero(got > LEAST_GAIN)
                f[a + good], c[a + good], gain[a + good] = feats[good, which[good]], at[good], got[good] * total[a + good, 0]
        split = np.flatnonzero(f >= 0)
        child[split] = size + 2 * np.arange(len(split))
        size += 2 * len(split)
        feature.append(f), cut.append(c), left.append(child), totals.append(total), gains.append(gain)
        on = np.flatnonzero(f[key] >= 0)  # the rows of leaves are done
        cells, channels, key = cells[on], channels[on], key[on]
        right = cells[np.arange(len(on)), f[key]] > c[key]
        place = np.full(n, -1)
        place[split] = np.arange(len(split))
        key = 2 * place[key] + right
        codes = (2 * codes[split][:, None] + np.arange(2)).ravel()
    return Branch(*[np.concatenate(p) for p in (feature, cut, left, totals, gains)])


@dataclass
class Crown:
    """The upper nodes of a tree. An end without `done` waits to be split, one with it is the root of a branch or a leaf."""

    code: list[int] = field(default_factory=lambda: [1])
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    done: list[bool] = field(default_factory=lambda: [False])
    totals: dict[int, list[float]] = field(default_factory=dict)  # of split nodes and leaves
    gain: dict[int, float] = field(default_factory=dict)

    def ends(self, cells: np.ndarray) -> np.ndarray:
        return Branch(np.array(self.feature), np.array(self.cut), np.array(self.left), np.empty((0, 0)), np.empty(0)).ends(cells)

    def split(self, at: int, feature: int, cut: int, small: tuple[bool, bool]) -> None:
        self.feature[at], self.cut[at], self.left[at] = feature, cut, len(self.code)
        for side in (0, 1):
            self.code.append(2 * self.code[at] + side)
            self.feature.append(-1), self.cut.append(0), self.left.append(-1), self.done.append(small[side])


def feature_cuts(train: DataFrame) -> list[np.ndarray]:
    """Cut points of every feature: between all its values if these are at most `BINS`, else its quantiles."""
    x = vector_to_array("features")
    d = len(train.select(x.alias("x")).first()["x"])
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    got = train.select(x.alias("x")).agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000) for i in range(d)]).first()

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[np.ndarray] = [np.empty(0)] * d
        for b in batches:
            rows = np.array(b["x"].tolist(), dtype=float).reshape(len(b), d)
            seen = [np.unique(np.concatenate([s, rows[:, i]]))[:BINS + 1] for i, s in enumerate(seen)]
        for i, s in enumerate(seen):
            yield pd.DataFrame({"f": i, "x": s})

    values = train.select(x.alias("x")).mapInPandas(few, "f int, x double").distinct().groupBy("f").agg(
        F.slice(F.array_sort(F.collect_set("x")), 1, BINS + 1).alias("x")).collect()  # at most 33 values of a feature from a task
    known = {r["f"]: np.array(r["x"]) for r in values}
    return [(known[i][1:] + known[i][:-1]) / 2 if len(known[i]) <= BINS else np.unique(got[i]) for i in range(d)]


def random_cuts(train: DataFrame, seed: int) -> list[np.ndarray]:
    """Cut points drawn at random from the range of every feature."""
    x = vector_to_array("features")
    d = len(train.select(x.alias("x")).first()["x"])
    ends = train.select(x.alias("x")).agg(*[e for i in range(d) for e in (F.min(F.col("x")[i]), F.max(F.col("x")[i]))]).first()
    rng = np.random.default_rng(seed)
    return [np.sort(rng.uniform(ends[2 * i], ends[2 * i + 1], BINS - 1)) for i in range(d)]


def _matrix(held: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(held), np.uint8).reshape(-1, d)


class DeepForest:
    """A fitted forest: cut points, the upper nodes of every tree, and the path of its table of branches."""

    def __init__(self, spark, cuts: list[np.ndarray], crowns: list[Crown], path: str, classes: int, mean: float, std: float, overall: list[float]):
        self.spark, self.cuts, self.crowns, self.path, self.classes, self.mean, self.std = spark, cuts, crowns, path, classes, mean, std
        self.overall = overall  # of all training rows: the vote of a tree for which none was drawn

    @property
    def branches(self) -> DataFrame:
        return self.spark.read.schema("tree int, place int, branch binary").parquet(self.path)

    def votes(self, df: DataFrame) -> DataFrame:
        """Rows with `votes`, the mean of the trees' outputs. Rows in the same bins are scored once."""
        cell = cells_of(self.cuts)
        rows = df.withColumn("__c", cell(vector_to_array("features")))
        d, trees, outputs = len(self.cuts), len(self.crowns), self.classes or 1
        sent = self.spark.sparkContext.broadcast(self.crowns)

        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [_matrix(b["__c"].tolist(), d) for b in batches]
            if not held:
                return
            held = np.concatenate(held)
            for t, crown in enumerate(sent.value):
                for place, part in _by_place(crown.ends(held)):
                    yield pd.DataFrame({"tree": [t], "place": [place], "block": [held[part].tobytes()]})

        names = [f"v{i}" for i in range(outputs)]

        def voted(blocks: pa.Table, branch: pa.Table) -> pa.Table:
            held = _matrix(blocks.column("block").to_pylist(), d)
            grown = Branch.of(branch.column("branch")[0].as_py()) if len(branch) else leaf(overall)
            out = outputs_of(grown.totals, std, mean, classes)[grown.ends(held)]
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(d), len(held), [None, pa.py_buffer(held.tobytes())])
            return pa.table([raw.cast(pa.binary()), *[pa.array(out[:, i]) for i in range(outputs)]], names=["__c", *names])

        std, mean, classes, overall = self.std, self.mean, self.classes, self.overall
        blocks = rows.select("__c").distinct().mapInPandas(dealt, "tree int, place int, block binary")
        tasks = _tasks(self.spark, self.crowns)
        met = blocks.repartition(tasks, "tree", "place").groupBy("tree", "place").cogroup(
            self.branches.repartition(tasks, "tree", "place").groupBy("tree", "place")).applyInArrow(
            voted, "__c binary, " + ", ".join(f"{n} double" for n in names))
        # the sums arrive in any order: a tie must not hang on their last digits
        total = met.groupBy("__c").agg(F.array(*[F.round(F.sum(n) / trees, 12) if self.classes else F.sum(n) / trees for n in names]).alias("votes"))
        return rows.join(total, "__c").drop("__c")

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.votes(df)
        if not self.classes:
            return out.withColumn("prediction", F.col("votes")[0]).drop("votes")
        best = (F.array_position("votes", F.array_max("votes")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumnRenamed("votes", "probability")

    def tables(self) -> list[tuple[Crown, dict[int, Branch]]]:
        """Every tree whole: as large as the model, for explanations that need all its paths."""
        held: list[dict[int, Branch]] = [{} for _ in self.crowns]
        for r in self.branches.toLocalIterator():
            held[r["tree"]][r["place"]] = Branch.of(bytes(r["branch"]))
        return list(zip(self.crowns, held))

    @property
    def featureImportances(self):  # noqa: N802 - named as Spark's models name it
        from pyspark.ml.linalg import Vectors

        d = len(self.cuts)

        def gained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for t, held in zip(b["tree"], b["branch"]):
                    g = Branch.of(held)
                    inner = g.feature >= 0
                    yield pd.DataFrame({"tree": t, "f": np.arange(d), "gain": np.bincount(g.feature[inner], g.gain[inner], d)})

        sums = self.branches.mapInPandas(gained, "tree int, f int, gain double").groupBy("tree", "f").agg(F.sum("gain").alias("gain"))
        table = np.zeros((len(self.crowns), d))
        for t, f, gain in sums.collect():  # trees x features rows
            table[t, f] = gain
        for t, crown in enumerate(self.crowns):
            for at, gain in crown.gain.items():
                table[t, crown.feature[at]] += gain
        whole = table.sum(axis=1, keepdims=True)
        mean = np.divide(table, whole, out=np.zeros_like(table), where=whole > 0).sum(axis=0)
        return Vectors.dense(mean / mean.sum() if mean.sum() > 0 else mean)


def outputs_of(totals: np.ndarray, std: float, mean: float, classes: int) -> np.ndarray:
    """(nodes, outputs) from the weight and value sums of nodes: class shares, or the mean."""
    share = totals[:, 1:] / np.maximum(totals[:, :1], 1e-300)
    return share if classes else share * std + mean


def _tasks(spark, crowns: list[Crown]) -> int:
    """Tasks for the ends of all trees: a few for every core, and more where a task would get very many ends."""
    ends = sum(f < 0 for c in crowns for f in c.feature)
    return max(1, min(ends, max(4 * spark.sparkContext.defaultParallelism, ends // 32)))


def _by_place(ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(ends, kind="stable")
    names, starts = np.unique(ends[order], return_index=True)
    return zip(names.tolist(), np.split(order, starts[1:]))


def cells_of(cuts: list[np.ndarray]):
    """UDF: the bins of a feature array, a byte each."""

    @F.pandas_udf("binary")
    def cell(v: pd.Series) -> pd.Series:
        rows = np.array(v.tolist(), dtype=float).reshape(len(v), len(cuts))
        bins = np.stack([np.searchsorted(c, rows[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
        return pd.Series([r.tobytes() for r in bins], dtype=object)

    return cell


def fit_forest(
    train: DataFrame, trees: int, depth: int, classes: int, m: int, seed: int, cuts: list[np.ndarray], bootstrap: bool = True,
    tasks: int | None = None, node_rows: int = NODE_ROWS,
) -> DeepForest:
    """A forest of (id, features, label); `classes` 0 is a regression. Without `bootstrap` rows in the same bins are one row."""
    spark, d = train.sparkSession, len(cuts)
    rows = train.select(cells_of(cuts)(vector_to_array("features")).alias("c"), F.xxhash64("id").alias("h"), F.col("label").cast("double").alias("y"))
    n, mean, std, *counts = train.agg(F.count("*"), F.avg("label"), F.stddev_pop("label"), *[F.count_if(F.col("label") == k) for k in range(classes)]).first()
    mean, std = (0.0, 1.0) if classes else (mean, std or 1.0)
    overall = [float(n), *map(float, counts)] if classes else [float(n), 0.0]
    if bootstrap:
        rows = rows.withColumn("w", F.lit(1.0))
    else:
        same = ["c", "y"] if classes else ["c"]
        y = [] if classes else [F.avg("y").alias("y")]
        rows = rows.groupBy(*same).agg(F.count("*").cast("double").alias("w"), F.min("h").alias("h"), *y)
    rows = rows.repartition(tasks or max(1, n // 20_000), "h").persist()
    held_rows = rows.count()

    def channels(w: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not classes:
            return np.stack([w, w * (y - mean) / std], axis=1)
        return np.concatenate([w[:, None], w[:, None] * (y[:, None] == np.arange(classes))], axis=1)

    def whole(batches: Iterator[pd.DataFrame]):
        """A task's rows as arrays; there are as many tasks as their number justifies."""
        parts = [(_matrix(b["c"].tolist(), d), b["h"].to_numpy(), b["w"].to_numpy(), b["y"].to_numpy()) for b in batches]
        return [np.concatenate(p) for p in zip(*parts)] if parts else None

    def draw(h: np.ndarray, t: int) -> np.ndarray:
        return drawn(h, t, seed) if bootstrap else np.ones(len(h))

    crowns = [Crown() for _ in range(trees)]
    if held_rows <= node_rows:
        for crown in crowns:
            crown.done[0] = True
    while not all(all(c.done[at] or c.feature[at] >= 0 for at in range(len(c.code))) for c in crowns):
        sent = spark.sparkContext.broadcast(crowns)

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = whole(batches)
            if got is None:
                return
            cells, h, w, y = got
            for t, crown in enumerate(sent.value):
                waits = np.array([not crown.done[at] and crown.feature[at] < 0 for at in range(len(crown.code))])
                if not waits.any():
                    continue
                ends, times = crown.ends(cells), draw(h, t)
                on = np.flatnonzero(waits[ends] & (times > 0))
                names, key = np.unique(ends[on], return_inverse=True)
                for a in range(0, len(names), 256):
                    part = (key >= a) & (key < a + 256)
                    here, at = on[part], key[part] - a
                    feats = tried(np.array([crown.code[p] for p in names[a:a + 256]]), t, seed, d, m)
                    both = np.concatenate([channels(w[here] * times[here], y[here]), np.ones((len(here), 1))], axis=1)
                    sums = summed(at, cells[here].astype(np.int64), both, feats)
                    yield pd.DataFrame({"tree": t, "place": names[a:a + 256], "sums": [s.tobytes() for s in sums]})

        def best(batches: pd.DataFrame) -> pd.DataFrame:
            sums = sum(np.frombuffer(s).reshape(m, BINS, -1) for s in sorted(batches["sums"]))
            gain, which, cut = (v[0] for v in best_splits(sums[None, ..., :-1]))
            left = float(sums[which, :cut + 1, -1].sum())
            return pd.DataFrame({"tree": [batches["tree"][0]], "place": [batches["place"][0]], "gain": [gain], "which": [which], "cut": [cut],
                                 "left": [left], "right": [float(sums[0, :, -1].sum()) - left], "totals": [sums[0, :, :-1].sum(axis=0).tolist()]})

        found = rows.mapInPandas(counted, "tree int, place int, sums binary").groupBy("tree", "place").applyInPandas(
            best, "tree int, place int, gain double, which int, cut int, left double, right double, totals array<double>").collect()
        for r in sorted(found, key=lambda r: (r["tree"], r["place"])):  # one row per node with more than `node_rows` rows
            crown, at = crowns[r["tree"]], r["place"]
            crown.totals[at] = r["totals"]
            if r["gain"] > LEAST_GAIN and crown.code[at].bit_length() - 1 < depth:
                feature = int(tried(np.array([crown.code[at]]), r["tree"], seed, d, m)[0, r["which"]])
                crown.gain[at] = r["gain"] * r["totals"][0]
                crown.split(at, feature, r["cut"], (r["left"] <= node_rows, r["right"] <= node_rows))
            else:
                crown.done[at] = True
        sent.unpersist()

    sent = spark.sparkContext.broadcast(crowns)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = whole(batches)
        if got is None:
            return
        cells, h, w, y = got
        for t, crown in enumerate(sent.value):
            times = draw(h, t)
            on = np.flatnonzero(times > 0)
            for place, part in _by_place(crown.ends(cells[on])):
                if place not in crown.totals:
                    i = on[part]
                    yield pd.DataFrame({"tree": [t], "place": [place], "cells": [cells[i].tobytes()], "w": [(w[i] * times[i]).tobytes()], "y": [y[i].tobytes()]})

    def grown(blocks: pd.DataFrame) -> pd.DataFrame:
        t, place = int(blocks["tree"][0]), int(blocks["place"][0])
        cells = _matrix(blocks["cells"].tolist(), d)
        w, y = np.frombuffer(b"".join(blocks["w"])), np.frombuffer(b"".join(blocks["y"]))
        order = np.lexsort((w, y, *cells.T))  # blocks arrive in any order
        branch = grow(cells[order], channels(w[order], y[order]), sent.value[t].code[place], t, seed, m, depth)
        return pd.DataFrame({"tree": [t], "place": [place], "branch": [branch.bytes()]})

    schema = "tree int, place int, branch binary"
    path = scratch(spark, "forest")
    blocks = rows.mapInPandas(dealt, "tree int, place int, cells binary, w binary, y binary")
    # told by number, the tasks are not merged for their few bytes: their work is far larger
    blocks.repartition(_tasks(spark, crowns), "tree", "place").groupBy("tree", "place").applyInPandas(grown, schema).write.parquet(path)
    # leaves with very many equal rows, which no task has to hold
    flat = [(t, at, bytearray(leaf(totals).bytes()))
            for t, crown in enumerate(crowns) for at, totals in crown.totals.items() if crown.feature[at] < 0]
    if flat:
        spark.createDataFrame(flat, schema).write.mode("append").parquet(path)
    rows.unpersist()
    return DeepForest(spark, cuts, crowns, path, classes, mean, std, overall)
