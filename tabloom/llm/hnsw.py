"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, merged by query.

Equal vectors are one node that keeps the few smallest ids a result can show, so a vector shared by very many rows costs
no more than any other and ties resolve exactly. A shard holds about ROWS nodes. Its graph is built in growing batches: a
whole batch walks the layers in step, each new node takes diverse neighbours from what it found and from its own batch,
and neighbours that become too full choose anew. Stored shards are flat arrays: vectors, and per layer the node numbers
and a padded table of neighbour numbers. Every query visits every shard, and the best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.base import stored

ROWS = 8192
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
BATCH = 256
NEAREST = 10


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x (B, k, d) to q (B, d)."""
    d = x - q[:, None, :]
    return np.einsum("bkd,bkd->bk", d, d)


def _ranged(x: np.ndarray, top: float) -> np.ndarray:
    """`x` as the walk needs it, if `top` is the largest component it meets: float32, or beyond the range in which
    its squares keep their digits, float64 divided by a power of two, which changes no comparison."""
    if top == 0 or 2.0**-40 <= top <= 2.0**40:
        return np.ascontiguousarray(x, np.float32)
    return np.ldexp(np.asarray(x, np.float64), -int(np.frexp(top)[1]))


def _top(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0))


def _exact(x: np.ndarray, q: np.ndarray) -> float:
    """Euclidean distance in double precision; where the squares leave its range, after a division by a power of two."""
    with np.errstate(over="ignore"):
        total = float(np.square(x - q).sum())
    if 2.0**-900 < total < np.inf:
        return float(np.sqrt(total))
    d = np.ldexp(x, -2) - np.ldexp(q, -2) if total else x - q
    power = int(np.frexp(_top(d))[1])
    with np.errstate(over="ignore"):
        return float(np.ldexp(np.sqrt(np.square(np.ldexp(d, -power)).sum()), power + (2 if total else 0)))


class Layer:
    """A graph over some nodes: padded neighbour numbers, -1 for none."""

    def __init__(self, size: int, links: int) -> None:
        self.links = links
        self.near = np.full((size, links), -1, np.int32)

    def walk(self, x: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `width` nodes found for each query from its start nodes (B, s), nearest first; -1 where fewer."""
        count = len(q)
        rows = np.arange(count)
        seen = np.zeros((count, len(x) + 1), bool)
        seen[:, -1] = True
        np.put_along_axis(seen, start.astype(np.int64), True, 1)
        ids = np.full((count, width), -1, np.int64)
        far = np.full((count, width), np.inf, x.dtype)
        done = np.ones((count, width), bool)
        s = start.shape[1]
        ids[:, :s], far[:, :s], done[:, :s] = start, _distances(x[start], q), start < 0
        far[:, :s][start < 0] = np.inf
        live = rows
        while len(live):
            open_far = np.where(done[live], np.inf, far[live])
            take = np.argsort(open_far, axis=1)[:, :2]
            usable = np.isfinite(np.take_along_axis(open_far, take, 1))
            keep = usable[:, 0]
            live, take, usable = live[keep], take[keep], usable[keep]
            if not len(live):
                break
            done[live[:, None], take] = True
            new = self.near[ids[live[:, None], take]].astype(np.int64)
            new[~usable] = -1
            new = new.reshape(len(live), -1)
            # a node reached from both expanded nodes counts once
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[live[:, None], new]] = -1
            seen[live[:, None], new] = True
            d = _distances(x[new], q[live])
            d[new < 0] = np.inf
            all_far = np.concatenate([far[live], d], axis=1)
            order = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            far[live] = np.take_along_axis(all_far, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], new], axis=1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], new < 0], axis=1), order, 1)
        order = np.lexsort((ids, far), axis=1)
        far, ids = np.take_along_axis(far, order, 1), np.take_along_axis(ids, order, 1)
        ids[~np.isfinite(far)] = -1
        return ids, far

    def choose(self, x: np.ndarray, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Diverse neighbours from candidates in order: one is taken if no taken one is nearer to it than the node
        itself; free places go to the nearest of those passed over."""
        count, width = ids.shape
        points = x[ids]
        norm = np.einsum("bkd,bkd->bk", points, points)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (points @ points.transpose(0, 2, 1))
        valid = ids >= 0
        taken = np.zeros((count, width), bool)
        room = np.full(count, self.links)
        for k in range(width):
            clear = ~((between[:, k, :] < far[:, k, None]) & taken).any(1)
            take = valid[:, k] & clear & (room > 0)
            taken[:, k] = take
            room -= take
        rank = np.where(valid, np.where(taken, 0, width) + np.arange(width), 3 * width)
        order = np.argsort(rank, axis=1)[:, : self.links]
        out = np.full((count, self.links), -1, np.int32)
        picked = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(ids, order, 1), -1)
        out[:, : picked.shape[1]] = picked
        return out

    def add(self, x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        """Link new nodes with diverse ones of their candidates, both ways."""
        near = self.choose(x, ids, far)
        self.near[nodes] = near
        to, source = near.ravel(), np.repeat(nodes, near.shape[1])
        ok = to >= 0
        to, source = to[ok], source[ok]
        order = np.lexsort((source, to))
        to, source = to[order], source[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        most = int(counts.max()) if len(counts) else 0
        if not most:
            return
        extra = np.full((len(targets), most), -1, np.int64)
        extra[np.repeat(np.arange(len(targets)), counts), np.arange(len(to)) - np.repeat(first, counts)] = source
        for k in range(0, len(targets), 512):
            t = targets[k : k + 512]
            both = np.concatenate([self.near[t].astype(np.int64), extra[k : k + 512]], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            d = _distances(x[both], x[t])
            d[(both < 0) | (both == t[:, None])] = np.inf
            order = np.argsort(d, axis=1)[:, : self.links * 2]
            d, both = np.take_along_axis(d, order, 1), np.take_along_axis(both, order, 1)
            both[~np.isfinite(d)] = -1
            few = (both >= 0).sum(1) <= self.links
            kept = np.full((len(t), self.links), -1, np.int32)
            width = min(self.links, both.shape[1])
            kept[few, :width] = both[few, :width]
            if (~few).any():
                kept[~few] = self.choose(x, both[~few], d[~few])
            self.near[t] = kept


class Graph:
    """Layers over the vectors of one shard; layer 0 has all nodes, every layer above about a LINKS-th of the one below."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, Layer]]) -> None:
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 11) -> Graph:
        x = _ranged(x, _top(x))
        draw = np.random.default_rng(seed).random(len(x))
        height = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)
        order = np.argsort(-height, kind="stable")
        x_, height = x[order], height[order]  # nodes of upper layers come first
        layers = [
            (np.arange(n), Layer(n, LINKS * (1 if level else 2)))
            for level in range(height.max(initial=0) + 1)
            if (n := int((height >= level).sum())) > (1 if level else 0)
        ]
        graph = cls(x_, layers)
        graph.order = order
        at = 0
        while at < len(x_):
            end = min(len(x_), at + min(BATCH, max(32, at)))
            graph._insert(np.arange(at, end))
            at = end
        return graph

    def _insert(self, nodes: np.ndarray) -> None:
        q = self.x[nodes]
        norm = np.einsum("ij,ij->i", q, q)
        inner = np.maximum(norm[:, None] + norm[None, :] - 2 * (q @ q.T), 0).astype(q.dtype)
        np.fill_diagonal(inner, np.inf)
        start = np.zeros((len(nodes), 1), np.int64)
        for _, layer in reversed(self.layers):
            size = len(layer.near)
            here = nodes < size
            first = int(nodes[0])
            if first and first < size or first and not here.any():
                ids, far = layer.walk(self.x[: max(size, first)], q, start, BUILD_WIDTH)
                # nodes not yet linked cannot be reached, as only linked ones have neighbours
            else:
                ids = np.full((len(nodes), 1), -1, np.int64)
                far = np.full((len(nodes), 1), np.inf, q.dtype)
            if here.any():
                own = np.flatnonzero(here)
                k = min(BUILD_WIDTH, len(own))
                best = np.argsort(inner[np.ix_(own, own)], axis=1)[:, :k]
                mates_far = np.take_along_axis(inner[np.ix_(own, own)], best, 1)
                mates = nodes[own][best]
                mates[~np.isfinite(mates_far)] = -1
                both, both_far = np.concatenate([ids[own], mates], 1), np.concatenate([far[own], mates_far], 1)
                rank = np.argsort(both_far, axis=1)[:, :BUILD_WIDTH]
                layer.add(self.x, nodes[own], np.take_along_axis(both, rank, 1), np.take_along_axis(both_far, rank, 1))
            if first:
                start = np.where(ids[:, :1] >= 0, ids[:, :1], 0)

    def search(self, q: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Numbers (B, k) of the nodes found nearest, -1 where fewer."""
        start = np.zeros((len(q), 1), np.int64)
        for level in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[level][1]
            ids, _ = layer.walk(self.x[: len(layer.near)], q, start, max(width, k) if level == 0 else 8)
            start = np.where(ids[:, : 1 if level else k] >= 0, ids[:, : 1 if level else k], 0)
            if level == 0:
                return ids[:, :k]
        return np.full((len(q), k), -1, np.int64)

    def flat(self) -> dict[str, bytes]:
        sizes = np.array([[len(layer.near), layer.links] for _, layer in self.layers], np.int32)
        return {"sizes": sizes.tobytes(), "near": b"".join(layer.near.tobytes() for _, layer in self.layers)}

    @classmethod
    def load(cls, x: np.ndarray, sizes: bytes, near: bytes) -> Graph:
        layers, at = [], 0
        numbers = np.frombuffer(near, np.int32)
        for n, links in np.frombuffer(sizes, np.int32).reshape(-1, 2):
            layer = Layer(0, int(links))
            layer.near = numbers[at : at + n * links].reshape(n, links)
            at += n * links
            layers.append((np.arange(n), layer))
        return cls(x, layers)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def index(vectors: DataFrame, key: str, vector: str, keep: int = NEAREST + 1, rows: int = ROWS) -> DataFrame:
    """One stored row per shard: shard, vectors, ids (the `keep` smallest of each node), and the flat graph.

    Shards never mix vectors of different length.
    """
    valid = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda v: v.cast("double") + F.lit(0.0)).alias("v")
    )
    ranked = valid.withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("k") <= keep)
    nodes = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // rows))
    placed = nodes.withColumn("shard", F.size("v").cast("long") * shards + F.pmod(F.xxhash64("v"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        x = np.array(table.column("v").to_pylist(), np.float64)
        ids = table.column("ids").to_pylist()
        first = np.argsort([i[0] for i in ids], kind="stable")
        x = x[first]
        graph = Graph.build(x)
        order = first[graph.order]
        flat = graph.flat()
        out = {
            "shard": [table.column("shard")[0].as_py()],
            "vectors": [x[graph.order].tobytes()],
            "ids": [[ids[i] for i in order]],
            "sizes": [flat["sizes"]],
            "near": [flat["near"]],
        }
        return pa.table(out, schema=pa.schema([
            ("shard", pa.int64()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("sizes", pa.binary()), ("near", pa.binary())
        ]))

    schema = "shard long, vectors binary, ids array<array<long>>, sizes binary, near binary"
    return stored(placed.groupBy("shard").applyInArrow(run, schema), "graphs")


def search(graphs: DataFrame, queries: DataFrame, key: str, vector: str, k: int = NEAREST, width: int = SEARCH_WIDTH) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k nearest found for every usable query, itself left out.

    A shard's graph and the queries it gets meet in one sorted stream, graph first, so a task holds one graph and one
    batch of queries.
    """
    valid = queries.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("query_id"), F.transform(F.col(vector), lambda v: v.cast("double") + F.lit(0.0)).alias("v")
    )
    shards = graphs.select("shard", F.floor(F.octet_length("vectors") / 8 / F.size("ids")).cast("int").alias("length"))
    by_length = shards.groupBy("length").agg(F.collect_list("shard").alias("shards"))  # one number per shard
    sent = valid.join(by_length, F.size("v") == F.col("length")).select(F.explode("shards").alias("shard"), F.lit(1).alias("kind"), "query_id", "v")
    empty = {"query_id": "cast(null as long)", "v": "cast(null as array<double>)"}
    blank = {"vectors": "cast(null as binary)", "ids": "cast(null as array<array<long>>)", "sizes": "cast(null as binary)", "near": "cast(null as binary)"}
    left = graphs.select("shard", F.lit(0).alias("kind"), *[F.expr(e).alias(n) for n, e in empty.items()], "vectors", "ids", "sizes", "near")
    right = sent.select("shard", "kind", "query_id", "v", *[F.expr(e).alias(n) for n, e in blank.items()])
    stream = left.union(right).repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = ids = exact = largest = None

        def answer(query: list[int], v: list[list[float]]) -> pa.RecordBatch:
            q = np.array(v, np.float64)
            top = max(_top(q), largest)
            now = graph if _ranged(exact[:1], top).dtype == graph.x.dtype == np.float32 else Graph(_ranged(exact, top), graph.layers)
            found = now.search(_ranged(q, top), k + 1, width)
            out: tuple[list, list, list] = ([], [], [])
            for i, numbers in enumerate(found):
                hits = []
                for n in numbers[numbers >= 0]:
                    score = _exact(exact[n], q[i])
                    hits += [(score, other) for other in ids[n] if other != query[i]]
                for score, other in sorted(hits)[:k]:
                    for column, value in zip(out, (query[i], other, score)):
                        column.append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"]
            )

        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            at = 0
            while at < len(kinds):
                if kinds[at] == 0:
                    row = {n: batch.column(n)[at].as_py() for n in ("vectors", "ids", "sizes", "near")}
                    ids = row["ids"]
                    exact = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                    largest = _top(exact)
                    graph = Graph.load(_ranged(exact, largest), row["sizes"], row["near"])
                    at += 1
                    continue
                end = at
                while end < len(kinds) and kinds[end] and end - at < BATCH:
                    end += 1
                part = batch.slice(at, end - at)
                yield answer(part.column("query_id").to_pylist(), part.column("v").to_pylist())
                at = end

    hits = stream.mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, every: int = 100) -> DataFrame:
    """The k nearest rows of every row whose key is divisible by `every`, over all rows of `vectors`.

    Rows with a null key or vector, a zero vector, or a null or non-finite component take no part. Equal distances are
    ordered by key. Rows that repeat a key count once per different vector. An empty table gives an empty result.
    """
    graphs = index(vectors, key, vector, k + 1)
    return search(graphs, vectors.where(F.col(key) % every == 0), key, vector, k)
