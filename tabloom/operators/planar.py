"""Silhouettes of points of a plane, without visiting all pairs.

A distance is smooth away from zero. Rows are sorted into a tree of squares. A square is seen from afar through a grid of
Chebyshev nodes: the weight of its rows is spread over the nodes once, and distances to the nodes stand for distances to
the rows. `ORDER` nodes a side leave an error of about 1e-12 of a distance, as rounding does. Rows nearer than the side of
a square are compared one by one. The work grows with the rows and not with their pairs; no row is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import written

ORDER = 12  # nodes a side
NODES = ORDER * ORDER
DEPTH = 26  # levels of squares; points closer than that are compared as they are
STEP = 3  # levels a counting pass adds
LEAF_ROWS = 1500
HELD_BYTES = 64 << 20  # of node weights that every task holds; larger leaves keep them below
MOST_LABELS = 256
CELLS = 250_000  # distances a task holds at once: few enough for its cache


def _basis(x: np.ndarray) -> np.ndarray:
    """(points, ORDER): interpolation weights of points in [-1, 1]."""
    j = np.arange(ORDER)
    waves = np.cos(np.arccos(np.clip(x, -1, 1))[:, None] * j)
    at = np.cos(j[:, None] * (2 * j + 1) * np.pi / (2 * ORDER))
    return (2 * waves @ at - 1) / ORDER


_LINE = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))
_GRID = np.stack([np.repeat(_LINE, ORDER), np.tile(_LINE, ORDER)], axis=1)


def _spread(unit: np.ndarray) -> np.ndarray:
    """(points, NODES): weights of points of a square of [-1, 1] on both sides."""
    return (_basis(unit[:, 0])[:, :, None] * _basis(unit[:, 1])[:, None, :]).reshape(len(unit), NODES)


def _codes(xy: np.ndarray, low: np.ndarray, side: float) -> np.ndarray:
    """Places along the Z curve through the smallest squares."""
    out = np.zeros(len(xy), dtype=np.int64)
    for axis in (0, 1):
        z = np.clip((xy[:, axis] - low[axis]) / side * 2.0 ** DEPTH, 0, 2 ** DEPTH - 1).astype(np.int64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            z = (z | (z << shift)) & mask
        out |= z << axis
    return out


@dataclass
class Squares:
    """The occupied squares, children after their parents. A leaf holds the rows from its code up to the next leaf's."""

    low: np.ndarray
    side: float
    level: np.ndarray
    code: np.ndarray  # along the Z curve of the smallest squares
    parent: np.ndarray
    leaf: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(self.parent, kind="stable")
        at = np.searchsorted(self.parent[order], np.arange(len(self.parent) + 1))
        self.children, self.starts = order, at
        self.sides = self.side / 2.0 ** self.level
        place = np.zeros((len(self.code), 2))
        for axis in (0, 1):
            for bit in range(DEPTH):
                place[:, axis] += ((self.code >> (2 * bit + axis)) & 1) * 2.0 ** bit
        self.corner = self.low + place * (self.side / 2.0 ** DEPTH)
        self.middle = self.corner + self.sides[:, None] / 2
        self.leaves = np.flatnonzero(self.leaf)[np.argsort(self.code[self.leaf], kind="stable")]
        self.leaf_codes = self.code[self.leaves]

    def leaf_of(self, xy: np.ndarray) -> np.ndarray:
        return self.leaves[np.searchsorted(self.leaf_codes, _codes(xy, self.low, self.side), side="right") - 1]

    def unit(self, cell: int, xy: np.ndarray) -> np.ndarray:
        return (xy - self.middle[cell]) / (self.sides[cell] / 2)

    def nodes(self, cell: int) -> np.ndarray:
        return self.middle[cell] + _GRID * (self.sides[cell] / 2)

    def met(self, targets: np.ndarray) -> tuple[list, list, list]:
        """(target, square) pairs: far from each other, far from the square only, and leaves too near."""
        far, seen, near = [], [], []
        t, s = targets, np.zeros(len(targets), dtype=np.int64)
        while len(t):
            a, b = self.corner[t], self.corner[s]
            gap = np.maximum(a - (b + self.sides[s, None]), b - (a + self.sides[t, None])).max(axis=1)
            gap = gap * (1 + 1e-9) + 1e-12 * self.sides[s]
            off = gap >= self.sides[s]
            both = off & (gap >= self.sides[t])
            close = ~off & self.leaf[s]
            for out, which in ((far, both), (seen, off & ~both), (near, close)):
                out.append(np.stack([t[which], s[which]], axis=1))
            on = np.flatnonzero(~off & ~close)
            first, n = self.starts[s[on]], self.starts[s[on] + 1] - self.starts[s[on]]
            t = np.repeat(t[on], n)
            s = self.children[np.repeat(first - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())] if len(on) else t
        return tuple(np.concatenate(p) if p else np.empty((0, 2), dtype=np.int64) for p in (far, seen, near))


def _squares(points: DataFrame, low: np.ndarray, side: float, leaf_rows: int) -> Squares:
    """Squares are cut while they hold more than `leaf_rows` rows; a pass counts the parts of all that are too full."""
    level, code, parent, leaf = [0], [0], [-1], [False]
    open_cells = [0]
    while open_cells:
        at = np.array(open_cells)
        order = np.argsort(np.array(code)[at])
        at = at[order]
        begin, depth = np.array(code)[at], np.array(level)[at]

        def counted(batches: Iterator[pd.DataFrame], at=at, begin=begin, depth=depth) -> Iterator[pd.DataFrame]:
            for b in batches:
                c = _codes(b[["x", "y"]].to_numpy(), low, side)
                i = np.maximum(np.searchsorted(begin, c, side="right") - 1, 0)
                part = (c - begin[i]) >> (2 * np.maximum(DEPTH - depth[i] - STEP, 0))
                whole = 1 << (2 * np.minimum(STEP, DEPTH - depth[i]))
                ok = (c >= begin[i]) & (part < whole)
                if ok.any():
                    keys, n = np.unique(at[i[ok]] * 4 ** STEP + part[ok], return_counts=True)
                    yield pd.DataFrame({"cell": keys // 4 ** STEP, "part": keys % 4 ** STEP, "n": n})

        got = points.select("x", "y").mapInPandas(counted, "cell bigint, part bigint, n bigint").groupBy("cell", "part").agg(F.sum("n").alias("n")).toPandas()
        open_cells = []
        for cell, parts in got.groupby("cell"):  # at most 64 parts of every square with more than `leaf_rows` rows
            counts = np.zeros(4 ** STEP, dtype=np.int64)
            counts[parts["part"]] = parts["n"]
            todo = [(int(cell), 0, 4 ** min(STEP, DEPTH - level[cell]))]
            while todo:
                here, lo, hi = todo.pop()
                if counts[lo:hi].sum() <= leaf_rows or level[here] == DEPTH:
                    leaf[here] = True
                elif hi - lo == 1:
                    open_cells.append(here)
                else:
                    width = (hi - lo) // 4
                    for k in range(4):
                        if counts[lo + k * width:lo + (k + 1) * width].any():
                            todo.append((len(level), lo + k * width, lo + (k + 1) * width))
                            level.append(level[here] + 1)
                            code.append(code[here] + (k << (2 * (DEPTH - level[here] - 1))))
                            parent.append(here)
                            leaf.append(False)
    return Squares(low, side, np.array(level), np.array(code, dtype=np.int64), np.array(parent), np.array(leaf))


def _weights(squares: Squares, rows: pd.DataFrame, labels: int) -> np.ndarray:
    """(squares, NODES, labels): weights of the leaves, and of the squares above them from their children."""
    out = np.zeros((len(squares.level), NODES, labels))
    for cell, held in zip(rows["cell"], rows["weights"]):
        out[cell] = np.frombuffer(held).reshape(NODES, labels)
    up = {}
    for cell in range(len(out) - 1, 0, -1):
        p = squares.parent[cell]
        k = tuple((squares.middle[cell] > squares.middle[p]).tolist())
        if k not in up:
            up[k] = _spread(_GRID / 2 + np.where(k, 0.5, -0.5)).T
        out[p] += up[k] @ out[cell]
    return out


def _hot(labels: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
    return np.stack([(labels[:, j] == name) for j, name in keys], axis=1).astype(float)


def _added(out: np.ndarray, q: np.ndarray, p: np.ndarray, weight: np.ndarray) -> None:
    """Add to out (rows of q, labels) the distances to p, by weight."""
    step = max(1, CELLS // max(len(p), 1))
    for a in range(0, len(q), step):
        d = np.subtract.outer(q[a:a + step, 0], p[:, 0])
        e = np.subtract.outer(q[a:a + step, 1], p[:, 1])
        d *= d
        e *= e
        d += e
        out[a:a + step] += np.sqrt(d, out=d) @ weight


def silhouettes(points: DataFrame, labelings: int, sizes: list[tuple[int, int, int]], leaf_rows: int = LEAF_ROWS) -> DataFrame | None:
    """(labeling, silhouette) of (id, v, labels), with `sizes` as (labeling, label, rows).

    None where the rows are not finite points of a line or plane with ids of their own, or have very many labels.
    """
    keys = sorted((j, name) for j, name, _ in sizes)
    count = {(j, name): n for j, name, n in sizes}
    if not 0 < len(keys) <= MOST_LABELS:
        return None
    first, dims = F.col("v")[0], F.size("v")
    second = F.when(dims > 1, F.get("v", F.lit(1))).otherwise(0.0)
    p = points.select("id", first.alias("x"), second.alias("y"), "labels", dims.alias("dims")).persist()
    finite = F.coalesce(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < 1e150) & (F.abs("y") < 1e150) & F.col("dims").between(1, 2) & F.col("id").isNotNull(), F.lit(False))
    n, good, *ends = p.agg(F.count("*"), F.count_if(finite), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n or n != good or not p.groupBy("id").count().where(F.col("count") > 1).isEmpty():
        p.unpersist()
        return None
    low, side = np.array(ends[:2]), max(ends[2] - ends[0], ends[3] - ends[1]) or 1.0
    leaf_rows = max(leaf_rows, int(2.5 * n * len(keys) * NODES * 8 / HELD_BYTES))
    spark = points.sparkSession
    squares = _squares(p, low, side, leaf_rows)
    sent = spark.sparkContext.broadcast(squares)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["cell"] = sent.value.leaf_of(b[["x", "y"]].to_numpy()).astype(np.int64)
                yield b[["cell", "x", "y", "labels"]]

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        cell, xy = int(b["cell"].iloc[0]), np.ascontiguousarray(b[["x", "y"]].to_numpy())
        labels = np.array(b["labels"].tolist(), dtype=np.int32)
        total = np.zeros((NODES, len(keys)))
        for a in range(0, len(xy), 4096):
            total += _spread(sent.value.unit(cell, xy[a:a + 4096])).T @ _hot(labels[a:a + 4096], keys)
        return pd.DataFrame({"cell": [cell], "xy": [xy.tobytes()], "labels": [labels.tobytes()], "weights": [total.tobytes()]})

    leaves = squares.leaves
    tasks = max(1, min(len(leaves), max(3 * spark.sparkContext.defaultParallelism, len(leaves) // 64)))
    # told by number, the tasks are not merged for their few bytes: their work is far larger
    blocks = written(p.mapInPandas(placed, "cell bigint, x double, y double, labels array<int>").repartition(tasks, "cell").groupBy("cell").applyInPandas(
        packed, "cell bigint, xy binary, labels binary, weights binary"), "squares")
    p.unpersist()
    weights = _weights(squares, blocks.select("cell", "weights").toPandas(), len(keys))  # at most HELD_BYTES
    held = spark.sparkContext.broadcast(weights)
    near = squares.met(leaves)[2]  # a few squares of every size a leaf
    pairs = spark.createDataFrame(pd.DataFrame({"target": near[:, 0], "cell": near[:, 1]}))

    def arrays(r) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r.xy).reshape(-1, 2), np.frombuffer(r.labels, np.int32).reshape(-1, labelings)

    def scored(b: pd.DataFrame) -> pd.DataFrame:
        tree, target = sent.value, int(b["target"].iloc[0])
        q, own = arrays(next(r for r in b.itertuples() if r.cell == target))
        q, back = np.unique(q, axis=0, return_inverse=True)  # equal points are measured once
        out = np.zeros((len(q), len(keys)))
        for r in b.itertuples():
            rows, labels = arrays(r)
            rows, place = np.unique(rows, axis=0, return_inverse=True)
            weight = np.zeros((len(rows), len(keys)))
            np.add.at(weight, place.ravel(), _hot(labels, keys))
            _added(out, q, rows, weight)
        far, seen, _ = tree.met(np.array([target]))
        grid = np.zeros((NODES, len(keys)))
        for cell in far[:, 1]:
            _added(grid, tree.nodes(target), tree.nodes(cell), held.value[cell])
        for cell in seen[:, 1]:
            _added(out, q, tree.nodes(cell), held.value[cell])
        for a in range(0, len(q), 4096):
            out[a:a + 4096] += _spread(tree.unit(target, q[a:a + 4096])) @ grid
        total = out[back.ravel()]
        sums = []
        for j in range(labelings):
            cols = [i for i, k in enumerate(keys) if k[0] == j]
            if len(cols) < 2:  # one cluster only: no score
                continue
            names, n = np.array([keys[i][1] for i in cols]), np.array([count[keys[i]] for i in cols], dtype=float)
            on = np.flatnonzero(own[:, j] >= 0)
            mine = np.searchsorted(names, own[on, j])
            t, rows = total[on][:, cols], np.arange(len(on))
            a = t[rows, mine] / np.maximum(n[mine] - 1, 1)
            t = t / n
            t[rows, mine] = np.inf
            other = t.min(axis=1)
            most = np.maximum(a, other)
            s = np.where((n[mine] > 1) & (most > 0), (other - a) / np.where(most > 0, most, 1), 0.0)
            sums.append((j, float(s.sum()), len(on)))
        return pd.DataFrame(sums, columns=["labeling", "s", "n"])

    met = blocks.drop("weights").join(F.broadcast(pairs), "cell")  # a few numbers a leaf
    return met.repartition(tasks, "target").groupBy("target").applyInPandas(scored, "labeling int, s double, n bigint").where("n > 0").groupBy(
        "labeling").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
