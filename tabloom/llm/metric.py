"""Exact Jaccard join of shingle sets in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

Jaccard distance is a metric, and documents link within EPSILON. Equal sets are one node.

1. Pivots are separated sets from a bounded sample. A node's region is its nearest pivot, if that lies within RADIUS, else
   the remote region. By the triangle inequality a partner of x in region i is at most EPSILON nearer to its pivot than x is,
   so x also visits every region whose pivot is within RADIUS + EPSILON and within 2 EPSILON of the distance to its own
   pivot, and the remote region if no pivot is within RADIUS - EPSILON. Nodes within EPSILON of a pivot link to it and
   are one component, which settles large groups of near copies without comparing their members.
2. Unrelated documents are all at distance 1, where no pivot tells them apart. So regions recurse into classes of the
   shingle universe: a linked pair differs in at most D shingles, so of more than D classes that are not empty in a node, one
   is left where both have the same shingles. In that class's own space every distinct projection is a pivot, and its
   Voronoi region of radius 0 holds exactly the nodes that coincide there. A node visits the regions of D + 1 classes, those with
   most rare shingles: what many unlike texts share, such as a frequent line, would else make regions of all who hold it. The number of classes follows from the size;
   nodes near a step of it visit the next one too, and the few nodes with too many empty classes ask for a finer cut
   from all sizes that could match.
3. A region that one component owns is finished. Any other takes its smallest node as pivot. The exact distances to it link
   what is near, and cut the region into rings of width EPSILON: linked nodes lie in the same or in neighbouring rings, so
   each node is copied into the next ring, and rings that still hold several components are compared exactly, in blocks.
   Counts per cell of the hash space bound every similarity from above and spare most nodes the comparison of full sets.
   Overlapping regions are joined at once, in blocks, where that moves no more rows.

Node and shingle identity rest on 64-bit hashes; every link is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.base import brief_shuffles, forget, map_batches, stored
from tabloom.llm.minhash import contracted, node_id
from tabloom.llm.shingles import mix, text_shingles

WIDTH = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
EPSILON = 1 - PERCENT / 100
RADIUS = 0.5
#: Texts sampled for pivots, their most bytes, and the least distance between two pivots.
SAMPLE, SAMPLE_BYTES, APART = 512, 1 << 15, 0.8
#: Texts sampled for common shingles, how many of them hold one, and the most common shingles kept. All others are RARE.
COMMON_SAMPLE, COMMON_TEXTS, COMMON, RARE = 4096, 4, 1 << 17, 16
#: Most shingles of a class on average. More than D classes must stay filled, which is rare to fail but for short texts.
FILL = 4.5
#: Sets up to a size are also cut at so many further depths, as theirs are the classes that chance may leave empty.
EXTRA = ((24, 3), (100, 1))
#: Nodes and bytes of sets of a block in the exact comparison of a ring; a task holds two blocks.
BLOCK, BLOCK_BYTES = 512, 8 << 20
_SLACK = 1e-9
_K = np.uint64(0x9E3779B97F4A7C15)


def most_apart(n: int) -> int:
    """D: most shingles in which a set of n can differ from a linked one."""
    return (100 - PERCENT) * n // PERCENT


def depth(n: int) -> int:
    """Number of halvings of the universe after which a class holds at most FILL shingles of n."""
    k = 0
    while n > FILL * (1 << k):
        k += 1
    return k


def _classes(shingles: np.ndarray, k: int) -> np.ndarray:
    """Where each filled class begins: the set is sorted, and a class is a range of hashes."""
    if k == 0:
        return np.zeros(1, np.int64)
    top = shingles >> np.uint64(64 - k)
    return np.append(0, np.flatnonzero(top[1:] != top[:-1]) + 1)


def _extra(n: int) -> int:
    return next((more for size, more in EXTRA if n <= size), 0)


def own_depths(n: int) -> list[int]:
    """Depths at which every set of n shingles is cut: its own, that of larger partners, and more if it is short."""
    return list(range(depth(n), depth(100 * n // PERCENT) + _extra(n) + 1))


class Common:
    """Shingles that many unlike texts hold, each with the number of times the sample halves until it is as few as hold it."""

    def __init__(self, rows: list[tuple[int, int]] = ()) -> None:
        rows = sorted((shingle & (1 << 64) - 1, halvings) for shingle, halvings in rows)
        self.shingles = np.array([r[0] for r in rows], np.uint64)
        self.halvings = np.array([r[1] for r in rows], np.uint8)

    def rarity(self, x: np.ndarray) -> np.ndarray:
        """Per shingle the halvings, or RARE."""
        out = np.full(len(x), RARE, np.uint8)
        if len(self.shingles):
            at = np.searchsorted(self.shingles, x)
            at[at == len(self.shingles)] = 0
            found = self.shingles[at] == x
            out[found] = self.halvings[at[found]]
        return out


def projections(shingles: np.ndarray, k: int, rarity: np.ndarray | None = None) -> np.ndarray:
    """Keys of what the set holds in its filled classes: the first D + 1 by their own order, or all if they are fewer.

    Any order that depends on what a class holds would do. A key begins with its place: classes with most rare shingles come
    first, then those whose rarest common one is least common. What many unlike texts hold thus seldom makes a region.
    """
    at, most = _classes(shingles, k), most_apart(len(shingles))
    rarity = np.full(len(shingles), RARE, np.uint8) if rarity is None else rarity
    rare = np.minimum(np.add.reduceat((rarity == RARE).astype(np.int64), at), 15)
    place = 255 - (rare * 16 + np.maximum.reduceat(rarity % RARE, at))
    with np.errstate(over="ignore"):
        keys = mix(np.add.reduceat(mix(shingles ^ _K), at) + np.uint64(k) * _K)
    keys = place.astype(np.uint64) << np.uint64(56) | keys >> np.uint64(8)
    return np.partition(keys, most)[: most + 1] if len(keys) > most + 1 else keys


def finer(shingles: np.ndarray) -> int | None:
    """The depth a set must ask its smaller partners for, if too few classes are filled where both are cut anyway; else None.

    A pair shares a projection at every depth at which one of the two has more than D filled classes. Both are cut at the
    depth of the larger set and at its extra ones.
    """
    n, most = len(shingles), most_apart(len(shingles))
    k = depth(n)
    if most == 0 or any(len(_classes(shingles, d)) > most for d in range(k, k + _extra(n) + 1)):
        return None
    while len(_classes(shingles, k)) <= most:
        k += 1
    return k


def asked_depths(n: int, asked: list[tuple[int, int]]) -> list[int]:
    """Further depths that sets near n shingles ask for."""
    more = {k for size, k in asked if PERCENT * size <= 100 * n and PERCENT * n <= 100 * size}
    return sorted(more - set(own_depths(n)))


class Pivots:
    """A bounded number of sets, asked for their distances to any set."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.nodes = [node_id(s) for s in sets]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(shingles, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.keys, self.first = np.unique(shingles[order], return_index=True)
        self.last = np.append(self.first[1:], len(shingles))

    def shared(self, x: np.ndarray) -> np.ndarray:
        """Size of the intersection of x with each pivot."""
        if not len(self.keys):
            return np.zeros(len(self.sizes), np.int64)
        at = np.searchsorted(self.keys, x)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == x]
        if not len(at):
            return np.zeros(len(self.sizes), np.int64)
        times = self.last[at] - self.first[at]
        ends = np.cumsum(times)
        spans = np.repeat(self.first[at] - ends + times, times)
        return np.bincount(self.owner[spans + np.arange(ends[-1])], minlength=len(self.sizes))

    def placed(self, x: np.ndarray) -> tuple[int | None, list[int]]:
        """The node of a pivot that x links to, and the regions x belongs to or visits; 0 is the remote one."""
        if not len(self.sizes):
            return None, [0]
        both = self.shared(x)
        either = len(x) + self.sizes - both
        d = 1 - both / either
        near = d.min()
        linked = np.flatnonzero(100 * both >= PERCENT * either)
        visits = np.flatnonzero(d <= min(RADIUS + EPSILON, near + 2 * EPSILON) + _SLACK)
        regions = ([0] if near > RADIUS - EPSILON - _SLACK else []) + (visits + 1).tolist()
        return (self.nodes[linked[0]] if len(linked) else None), regions


def sampled(docs: DataFrame, most: int) -> DataFrame:
    """h and text of the different texts that come first by hash."""
    texts = docs.select("text", F.xxhash64("text").alias("h")).where(F.octet_length("text").between(1, SAMPLE_BYTES))
    first = texts.select("h").distinct().orderBy("h").limit(most)
    return texts.join(F.broadcast(first), "h").groupBy("h").agg(F.first("text").alias("text"))


def chosen_pivots(docs: DataFrame) -> Pivots:
    """Pivots at least APART from each other, from the SAMPLE different texts that come first by hash.

    The sample only steers how the work is cut: any pivots, or none, give the same links.
    """
    kept: list[np.ndarray] = []
    for row in sampled(docs, SAMPLE).orderBy("h").collect():
        s = text_shingles(row.text, WIDTH)
        if len(s) and all(len(np.intersect1d(s, p, assume_unique=True)) <= (1 - APART) * (len(s) + len(p)) / (2 - APART) for p in kept):
            kept.append(s)
    return Pivots(kept)


def common_shingles(sample: DataFrame) -> Common:
    """Shingles of at least COMMON_TEXTS sampled texts. They too only steer how the work is cut."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"shingle": np.concatenate([text_shingles(t, WIDTH) for t in batch["text"]]).view(np.int64)}

    texts = F.count("*").alias("texts")
    found = map_batches(sample.select("text"), "shingle long", run).groupBy("shingle").agg(texts).where(F.col("texts") >= COMMON_TEXTS)
    halvings = F.greatest(F.lit(0), F.floor(F.log2(COMMON_SAMPLE / F.col("texts")))).cast("int")
    rows = found.orderBy(F.desc("texts"), "shingle").limit(COMMON).select("shingle", halvings.alias("halvings"))
    return Common([tuple(r) for r in rows.collect()])


def keyed(shingles: np.ndarray, depths: list[int], regions: list[int], common: Common) -> np.ndarray:
    """Keys of all regions that a set belongs to or visits, at the given depths."""
    rarity = common.rarity(shingles)
    cut = np.concatenate([projections(shingles, k, rarity) for k in depths])
    with np.errstate(over="ignore"):
        return np.concatenate([mix(cut + np.uint64(r) * _K) if r else cut for r in regions]).view(np.int64)


class _Seen(set):
    """Nodes a task has met, so that copies are cut once; a table of bounded size."""

    LIMIT = 200_000

    def new(self, node: int) -> bool:
        if node in self:
            return False
        if len(self) >= self.LIMIT:
            self.clear()
        self.add(node)
        return True


def signatures(docs: DataFrame, pivots: Pivots, common: Common, asked: list[tuple[int, int]] | None = None) -> DataFrame:
    """doc_id, n_shingles, node (null without words), label (a linked pivot, else the node), the depth it asks for, and keys.

    `keys` are those of the own depths, or with `asked` of the depths asked for. They are null where another row of the task
    has the same set, and for sets so small that only equal ones link.
    """

    def run(batch: dict[str, list], state: tuple[_Seen, dict]) -> dict[str, list]:
        seen, cuts = state
        names = ("n_shingles", "node", "label", "asks", "keys")
        out: dict[str, list] = {k: [] for k in names}
        for text in batch["text"]:
            s = text_shingles(text, WIDTH)
            n = len(s)
            row = (0, None, None, None, None)
            if n:
                node = node_id(s)
                pivot, regions = pivots.placed(s)
                keys = None
                if most_apart(n) and seen.new(node):
                    if n not in cuts:
                        cuts[n] = own_depths(n) if asked is None else asked_depths(n, asked)
                    keys = keyed(s, cuts[n], regions, common) if cuts[n] else None
                row = (n, node, node if pivot is None else pivot, finer(s), keys)
            for k, v in zip(names, row):
                out[k].append(v)
        return out | {"doc_id": batch["doc_id"], "keys": pa.array(out["keys"], pa.list_(pa.int64()))}

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_shingles long, node long, label long, asks int, keys array<long>"
    return map_batches(docs.select("doc_id", "text"), schema, run, lambda: (_Seen(), {}))


def folded(shingles: np.ndarray) -> bytes:
    """Shingles per cell of the hash space; no bytes for a set too large for the counters, of which nothing is said."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.uint16).tobytes() if counts.max() < 1 << 16 else b""


def hopeful(cells: list[bytes], labels: list[int]) -> np.ndarray:
    """For each set the first one it is connected to through sets of other labels that it may link to, or -1 for none.

    Two sets share at most the smaller count of every cell, summed up.
    """
    known = np.array([len(c) > 0 for c in cells])
    counts = np.array([np.frombuffer(c or bytes(512), np.uint16) for c in cells]).astype(np.int32)
    size, group = counts.sum(axis=1), np.unique(labels, return_inverse=True)[1]
    out = np.full(len(cells), -1)
    for i in range(len(cells) - 1):
        other = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        both = np.minimum(counts[i], counts[other]).sum(axis=1)
        near = (100 * both >= PERCENT * (size[i] + size[other] - both)) | ~known[other] | (not known[i])
        if near.any():
            both = np.append(other[near], i)
            old = out[both]
            root = int(min(both.min(), old[old >= 0].min(initial=both.min())))
            out[np.isin(out, old[old >= 0])] = root
            out[both] = root
    return out


def _shared(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of intersection and union of two sets of sorted hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    either = len(np.union1d(x, y))
    return len(x) + len(y) - either, either


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add `linked` and `ring` (the distance in whole EPSILON) to pairs (u, v, x, y) of nodes u and v, from their full sets."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = [_shared(a, b) for a, b in zip(batch["a"], batch["b"])]
        return {c: batch[c] for c in ("u", "v", "x", "y")} | {
            "linked": [100 * i >= PERCENT * either for i, either in found],
            "ring": [int((1 - i / either) / EPSILON + _SLACK) for i, either in found],
        }

    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    both = both.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u")
    return map_batches(both.select("u", "v", "x", "y", "a", "b"), "u long, v long, x long, y long, linked boolean, ring int", run)


def full_sets(docs: DataFrame, sigs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes as bytes, for the nodes listed; one document stands for all with an equal set."""
    ids = sigs.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct()
    chosen = docs.select("doc_id", "text").join(stored(ids, "ids"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def run(batch: dict[str, list], seen: _Seen) -> dict[str, list]:
        sets = [s for t in batch["text"] if len(s := text_shingles(t, WIDTH)) and seen.new(node_id(s))]
        return {"node": [node_id(s) for s in sets], "members": [s.tobytes() for s in sets], "cells": [folded(s) for s in sets]}

    # a set that tasks found twice only repeats a link
    return stored(map_batches(chosen.select("text"), "node long, members binary, cells binary", run, _Seen), "sets")


def _relabelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace `label` by the label of its component in `labels` (node, label)."""
    above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return df.join(above, "label", "left").withColumn("label", F.coalesce("above", "label")).drop("above")


def bridges(sets: list[np.ndarray], labels: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of labels joined by linked sets, as few as connect them."""
    sizes = np.array([len(s) for s in sets])
    shingles = np.concatenate(sets)
    order = np.argsort(shingles, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    kinds, first = np.unique(shingles[order], return_index=True)
    last = np.append(first[1:], len(shingles))
    names, group = np.unique(labels, return_inverse=True)
    for i, s in enumerate(sets):
        others = np.flatnonzero(group != group[i])
        if not len(others):
            return  # all are connected
        at = np.searchsorted(kinds, s)
        spans = np.repeat(first[at] - np.append(0, np.cumsum(last[at] - first[at])[:-1]), last[at] - first[at])
        both = np.bincount(owner[spans + np.arange(len(spans))], minlength=len(sets))[others]
        for j in others[100 * both >= PERCENT * (sizes[i] + sizes[others] - both)]:
            if group[j] != group[i]:
                yield int(names[group[i]]), int(names[group[j]])
                group[group == group[j]] = group[i]


def _blocks() -> Column:
    """Number of blocks of the nodes of a group, from their column n."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")


def _at_once(rows: DataFrame, by: str) -> DataFrame:
    """Per group its rows, its different nodes and the blocks of these."""
    nodes = rows.select(by, "node", "n").distinct().groupBy(by).agg(F.count("*").alias("nodes"), _blocks().alias("blocks"))
    return nodes.join(rows.groupBy(by).agg(F.count("*").alias("rows")), by)


def _dealt(rows: DataFrame) -> DataFrame:
    """Deal rows (key, ring, node, label, blocks) out to pairs (lo, hi) of blocks."""
    cut = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select("key", F.col("ring").cast("int").alias("ring"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "label")


def _rings(own: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of labels inside regions (key, center, label, node, n) that several components still share.

    Regions of equal members are joined once. Regions that overlap are joined as one if that moves no more rows. Any other is cut into rings around its center and bands of sizes; a node goes to its own and the next. Rings of several components are
    dealt out in blocks, and a task compares two blocks.
    """
    same = own.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.min("center").alias("c"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("b"),
    )
    same = same.where("lo < hi and size > 2").groupBy("c", "a", "b", "size").agg(F.min("key").alias("key")).select("key")
    own = stored(own.join(same, "key"), "regions")
    # regions that share nodes are one family, and a family that fits in a block is compared once, not region by region
    family = contracted(own.select(F.col("center").alias("u"), F.col("node").alias("v"))).withColumnRenamed("label", "family")
    own = own.join(family, "node")
    # so is a larger one whose blocks hold no more rows than the rings and bands of its regions would, four a member at least
    fits = _at_once(own, "family").select("family", (F.col("nodes") * F.col("blocks") <= 4 * F.col("rows")).alias("fits"))
    own = stored(own.join(fits, "family"), "families")
    whole = own.where("fits").select(F.col("family").alias("key"), F.lit(-1).alias("ring"), "node", "label", "n").distinct()
    large = own.where("not fits").select("key", "center", "node", "label", "n")
    pairs = large.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    rings = measured(pairs.distinct(), sets).select(F.col("u").alias("center"), F.col("v").alias("node"), "ring")
    rows = large.join(stored(rings, "rings"), ["center", "node"], "left").withColumn("ring", F.coalesce("ring", F.lit(0)))
    # sizes of linked nodes differ by 100 / PERCENT at most, which makes bands of sizes windows of the same kind
    band = F.floor(F.ln("n") / math.log(100 / PERCENT) + _SLACK).cast("int")
    rows = rows.withColumn("ring", F.explode(F.array(F.col("ring"), F.col("ring") + 1)))
    rows = rows.withColumn("band", F.explode(F.array(band, band + 1)))
    rows = stored(rows.select("key", (F.col("ring") * 10_000 + F.col("band")).alias("ring"), "node", "label", "n").union(whole), "ringed")
    groups = rows.groupBy("key", "ring").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), _blocks().alias("blocks"),
    )
    cut = _dealt(rows.join(groups.where("lo < hi").select("key", "ring", "blocks"), ["key", "ring"]))
    group = ("key", "ring", "lo", "hi")

    def grouped(batches: Iterator[pa.RecordBatch], last: str) -> Iterator[tuple[list, list, list, list]]:
        """(group, nodes, labels, values of the last column) of rows sorted by group."""
        now, nodes, labels, values = None, [], [], []
        for batch in batches:
            for *key, node, label, value in zip(*[batch.column(c).to_pylist() for c in (*group, "node", "label", last)]):
                if now != key:
                    if now is not None:
                        yield now, nodes, labels, values
                    now, nodes, labels, values = key, [], [], []
                nodes.append(node)
                labels.append(label)
                values.append(value)
        if now is not None:
            yield now, nodes, labels, values

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, nodes, labels, cells in grouped(batches, "cells"):
            first = hopeful(cells, labels)
            at = np.flatnonzero(first >= 0)
            columns = [pa.array([k] * len(at), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
            rest = [pa.array(np.array(x, np.int64)[i]) for x, i in ((nodes, at), (labels, at), (nodes, first[at]))]
            yield pa.RecordBatch.from_arrays([*columns, *rest], names=[*group, "node", "label", "first"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], None] = {}
        for _, _, labels, raw in grouped(batches, "members"):
            found.update(dict.fromkeys(bridges([np.frombuffer(x, np.uint64) for x in raw], labels)))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    # counts per cell are a few hundred bytes a node: what they rule out does not bring its set along
    light = cut.join(sets.select("node", "cells"), "node").repartition(*group).sortWithinPartitions(*group)
    left = stored(light.mapInArrow(chosen, "key long, ring int, lo int, hi int, node long, label long, first long"), "hopeful")
    # what may link is often met in many regions: a circle whose blocks hold no more rows than that is compared once
    circle = contracted(left.select(F.col("first").alias("u"), F.col("node").alias("v"))).withColumnRenamed("label", "circle")
    left = left.join(circle, "node").join(own.select("node", "n").distinct(), "node")
    left = stored(left.select(*group, "node", "label", "n", "circle"), "circles")
    small = _at_once(left, "circle").select("circle", "blocks", (F.col("nodes") * F.col("blocks") <= F.col("rows")).alias("small"))
    left = left.join(small, "circle")
    once = left.where("small").select(F.col("circle").alias("key"), F.lit(-2).alias("ring"), "node", "label", "blocks").distinct()
    left = left.where("not small").select(*group, "node", "label").union(_dealt(once))
    whole = left.join(sets.select("node", "members"), "node").repartition(*group).sortWithinPartitions(*group)
    return whole.mapInArrow(linked, "u long, v long")


def components(docs: DataFrame, sigs: DataFrame, keys: DataFrame, pivots: Pivots, common: Common) -> DataFrame:
    """(node, label) where labels of `sigs` are joined further: equal labels are one component.

    `keys` are the signatures with their keys. Each table is deleted as soon as nothing reads it any more.
    """
    held = [keys]
    cells = keys.select(F.explode("keys").alias("key"), "label", "node", F.col("n_shingles").alias("n"))
    # pairs of a size and a depth, met by chance among the few sizes of short texts alone, if at all
    asked = [tuple(r) for r in sigs.where("asks is not null").select("n_shingles", "asks").distinct().collect()]
    if asked:
        more = stored(signatures(docs, pivots, common, asked), "asked")
        held.append(more)
        cells = cells.union(more.select(F.explode("keys").alias("key"), "label", "node", F.col("n_shingles").alias("n")))
    shared = cells.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("center"))
    shared = stored(shared.where("lo < hi").select("key", "center"), "shared")
    met = stored(cells.join(shared, "key").distinct(), "own")
    forget(*held, shared)
    middle = met.where(F.col("node") == F.col("center")).select("key", F.col("label").alias("x"), F.col("n").alias("m"))
    own = stored(met.join(middle, "key"), "regions")
    forget(met)
    sets = full_sets(docs, sigs, own.select("node").distinct())
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * PERCENT
    stars = own.where(F.col("label") != F.col("x")).where(fits).select(F.col("center").alias("u"), F.col("node").alias("v"), "x", F.col("label").alias("y"))
    linked = measured(stars.distinct(), sets).where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    first = contracted(linked)
    rest = stored(_relabelled(own.select("key", "center", "label", "node", "n"), first), "labelled")
    forget(own)
    second = contracted(_rings(rest, sets))
    forget(rest, sets)
    names = sigs.where("node is not null").select("node", "label").distinct()
    return stored(_relabelled(_relabelled(names, first), second), "components")


def joined(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and blank texts have no shingles and are linked with nothing; their component is their own doc_id. Equal sets are
    linked. Rows that repeat a doc_id are joined by their own texts, and a row without a doc_id never names a component that
    has another. An empty table gives an empty result.
    """
    with brief_shuffles(docs.sparkSession):
        sample = stored(sampled(docs, COMMON_SAMPLE), "sample")
        pivots, common = chosen_pivots(sample), common_shingles(sample)
        keys = stored(signatures(docs, pivots, common), "signatures")
        sigs = stored(keys.drop("keys"), "nodes")
        labels = components(docs, sigs, keys, pivots, common).select(F.col("node").alias("_node"), F.col("label").alias("final"))
        own = sigs.join(labels, F.col("node") == F.col("_node"), "left").select("doc_id", "n_shingles", "final")
        own = stored(own, "joined")
    first = own.where("final is not null").groupBy("final").agg(F.min("doc_id").alias("first"))
    component = F.when(F.col("final").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return own.join(first, "final", "left").select("doc_id", "n_shingles", component.alias("component_id"))
