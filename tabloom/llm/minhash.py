"""Near-duplicate documents by one-permutation MinHash with optimal densification, banded buckets and star edges.

1. One pass over the texts: a document's 5-word shingles become 64-bit hashes; BINS equal ranges of the hash space keep
   their smallest member, an empty range borrows from the first filled range of its own fixed random order, and each ROWS
   ranges make one band. Equal sets share a node, so exact copies take no further part.
2. Nodes that share a band form a bucket. A bucket adds edges to one center only, never pairs within it.
3. Edges are confirmed on full shingle sets, and components follow by contraction: each node goes to its smallest
   neighbour until no edge is left.
4. Stars lose no link. As components are wanted, a bucket inside one component is finished. Any other bucket of more than
   two is compared exactly, in blocks of bounded size that emit one link per pair of components, never pairs of rows.

A pair at similarity 0.75 shares no band with probability below 6e-6 (32 bands of 4), and below 1e-9 from 0.80 up.
Node and shingle identity rest on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.base import boxed, map_batches, stored, unboxed
from tabloom.llm.shingles import WordHashes, mix, shingle_set

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members and bytes of sets of a block in the exact comparison of buckets that a star does not settle.
BLOCK, BLOCK_BYTES = 512, 8 << 20

_EDGES = (np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)).astype(np.uint64)
_ORDERS = np.array([np.random.default_rng(1_000 + i).permutation(BINS) for i in range(BINS)])
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest member of each hash range, densified; `shingles` is sorted and not empty."""
    at = np.append(np.searchsorted(shingles, _EDGES), len(shingles))
    filled = at[1:] > at[:-1]
    source = np.arange(BINS)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        orders = _ORDERS[empty]
        source[empty] = orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]
    return shingles[at[source]]


def bands(shingles: np.ndarray) -> np.ndarray:
    parts = signature(shingles).reshape(BANDS, ROWS)
    acc = _BAND.copy()
    for k in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return acc.view(np.int64)


def node_id(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null without words) and its bands."""

    def run(batch: dict[str, list], hashes: WordHashes) -> dict[str, list]:
        sets = [shingle_set(t, hashes) for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "text_hash": batch["text_hash"],
            "n_shingles": [len(s) for s in sets],
            "node": [node_id(s) if len(s) else None for s in sets],
            "bands": pa.array([bands(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
        }

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_hash long, n_shingles long, node long, bands array<long>"
    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), schema, run, WordHashes)


def full_sets(docs: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes as bytes, a row per document with words."""

    def run(batch: dict[str, list], hashes: WordHashes) -> dict[str, list]:
        sets = [s for t in batch["text"] if len(s := shingle_set(t, hashes))]
        return {"node": [node_id(s) for s in sets], "members": [s.tobytes() for s in sets]}

    return map_batches(docs.select("text"), "node long, members binary", run, WordHashes)


def _linked(pairs: DataFrame) -> DataFrame:
    """Keep (u, v) whose sets `a` and `b` are similar enough."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        u, v = [], []
        for i, j, a, b in zip(batch["u"], batch["v"], batch["a"], batch["b"]):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                u.append(i)
                v.append(j)
        return {"u": u, "v": v}

    return map_batches(pairs.select("u", "v", "a", "b"), "u long, v long", run)


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) that hold on full sets. Plain shuffle joins: a center with very many edges is split at run time."""
    left = edges.join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    both = left.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u")
    return _linked(both)


def contracted(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(node, label) of every node that has an edge: equal labels where edges connect. Stored."""
    left = stored(edges.select("u", "v").where("u <> v").distinct(), "links")
    whole = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        step = ends.groupBy(F.col("e.u").alias("node")).agg(F.least(F.min("e.v"), F.min("e.u")).alias("to"))
        step = stored(step, "steps")
        if whole is None:
            whole = step.withColumnRenamed("to", "label")
        else:
            moved = whole.join(step.withColumnRenamed("node", "label"), "label", "left")
            whole = stored(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        a = left.join(step.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
        b = a.join(step.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        left = stored(b.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "links")
    return whole if whole is not None else left.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component label of column `node`; a node without edges is its own."""
    known = labels.select(F.col("node").alias(node), F.col("label").alias(name))
    return df.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def _fits(a: str, b: str) -> Column:
    """Set sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _starred(members: DataFrame) -> DataFrame:
    """Members (band, node, n) of buckets of two and more, with the bucket's size and its center, the smallest node."""
    first = members.groupBy("band").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    return members.join(first.select("band", "size", F.col("c.node").alias("center"), F.col("c.n").alias("center_n")), "band")


def _bridges(sets: list[np.ndarray], labels: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of labels joined by similar sets, as few as connect them."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = column.max() + 1 if len(column) else 0
    for start in range(0, width, 4096):
        here = (column >= start) & (column < start + 4096)
        table = np.zeros((len(sets), min(4096, width - start)), np.float32)
        table[owner[here], column[here] - start] = 1
        both += table @ table.T
    either = sizes[:, None] + sizes[None, :] - both
    ids = {x: x for x in labels}

    def root(x: int) -> int:
        while ids[x] != x:
            x = ids[x]
        return x

    for i, j in np.argwhere(np.triu(100 * both >= PERCENT * either, 1)):
        a, b = root(labels[i]), root(labels[j])
        if a != b:
            ids[max(a, b)] = min(a, b)
            yield a, b


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between components that share a bucket, found without pairs of rows.

    Buckets that lie in several components are cut into blocks of about BLOCK members or BLOCK_BYTES; a task compares two
    blocks at a time as a product of membership tables. Buckets of two were settled by their only edge.
    """
    own = _labelled(_labelled(members.where("size > 2"), labels, "node", "label"), labels, "center", "center_label")
    own = stored(own.select("band", "node", "n", "label", "center_label"), "labelled")
    apart = own.groupBy("band").agg(
        F.max((F.col("label") != F.col("center_label")).cast("int")).alias("apart"),
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"),
    )
    blocks = F.col("blocks")
    cut = own.join(apart.where("apart = 1"), "band").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "label")
    rows = cut.join(sets, "node").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, labels_ = None, [], []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if len(set(labels_)) > 1:
                out.extend(_bridges(held, labels_))

        for batch in batches:
            for band, lo, hi, label, raw in zip(*[batch.column(c).to_pylist() for c in ("band", "lo", "hi", "label", "members")]):
                if key != (band, lo, hi):
                    flush()
                    key, held, labels_ = (band, lo, hi), [], []
                held.append(np.frombuffer(raw, np.uint64))
                labels_.append(label)
        flush()
        pairs = list(dict.fromkeys(out))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def components(docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(node, label) of all nodes with a link to another node."""
    nodes = sigs.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = stored(_starred(nodes.select(F.explode("bands").alias("band"), "node", "n")), "members")
    shared = members.select("node").distinct()
    ids = sigs.join(shared, "node").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct()
    chosen = docs.select("doc_id", "text").join(stored(ids, "chosen"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = stored(full_sets(chosen), "sets")
    edges = members.where(F.col("node") != F.col("center")).where(_fits("n", "center_n"))
    labels = contracted(confirmed(edges.select(F.col("center").alias("u"), F.col("node").alias("v")).distinct(), sets))
    more = contracted(_rest(members, labels, sets)).select(F.col("node").alias("label"), F.col("label").alias("above"))
    known = labels.join(more, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    alone = more.join(labels.select("label").distinct(), "label", "left_anti")
    return stored(known.union(alone.select(F.col("label").alias("node"), F.col("above").alias("label"))), "components")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept."""
    sigs = stored(signatures(docs), "signatures")
    own = _labelled(sigs.select("doc_id", "text_hash", "n_shingles", "node"), components(docs, sigs), "node", "label")
    own = stored(own, "grouped")
    first = own.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("first"))
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return own.join(first, "label", "left").select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and blank texts have no shingles and are linked with nothing. Equal texts are one group. Rows that repeat a
    doc_id are grouped by their own texts; rows without a doc_id never lead a group that has one. An empty table gives
    an empty result.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that lead their group, with all their columns.

    Of rows equal in doc_id and text one stays. Rows go by joining the list of those to drop, so the texts are not
    moved while that list is small.
    """
    key = lambda a: [F.col(f"{a}_id"), F.col(f"{a}_hash")]
    groups = _grouped(docs)
    per = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"), F.max("kept").alias("kept"), F.max("n_shingles").alias("n"))
    per = stored(per.where("not kept or times > 1 and n > 0"), "dropped")
    drop = per.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "kept")
    row = boxed(docs).withColumns({"r_id": F.col("row.doc_id"), "r_hash": F.xxhash64(F.col("row.text"))})
    same = F.col("r_id").eqNullSafe(F.col("d_id")) & (F.col("r_hash") == F.col("d_hash"))
    out = row.join(drop, same, "left_anti").select("row")
    repeated = drop.where("kept")
    if not repeated.isEmpty():
        out = out.union(row.join(repeated, same, "left_semi").groupBy(*key("r")).agg(F.first("row").alias("row")).select("row"))
    return unboxed(out, docs.columns)
