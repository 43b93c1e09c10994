"""Exact nearest neighbours and all-pairs distance sums without emitting pairs.

Both work on (id, vector) tables with `array<double>` vectors. A small right side
(checked) is sent to every task. Otherwise rows are cut into blocks. A task of the
neighbour search sees one pair of blocks and emits k rows per query; cells around
pivots skip the block pairs that the triangle inequality rules out. Cells are cut
into blocks too, so copies of one point are spread. For sums a task holds one block
and all rows stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL_SIDE = 20_000
BLOCK_ROWS = 8_192
MAX_PIVOTS = 256
LEAST_BLOCKS = 64  # blocks of the distance sums, where there are rows for them
SUM_CELLS = 8_000_000  # sums a task holds at once
DISTANCE_CELLS = 500_000  # distances a task holds at once: few enough for its cache


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float) if len(column) else np.empty((0, 0))


def _nearest(qid, q, pid, p, k: int, skip_same: bool) -> Iterator[pd.DataFrame]:
    """The k nearest rows of p per row of q, ties by id, a slice of q at a time."""
    if not len(q) or not len(p):
        return
    p2 = (p * p).sum(axis=1)
    step = max(1, min(1024, DISTANCE_CELLS // max(len(p), 1)))
    for a in range(0, len(q), step):
        part = q[a:a + step]
        d2 = (part * part).sum(axis=1)[:, None] + p2[None, :] - 2 * part @ p.T
        if skip_same:
            d2[qid[a:a + step][:, None] == pid[None, :]] = np.inf
        m = min(k, len(p))
        slack = 1e-9 * ((part * part).sum(axis=1) + p2.max() + 1e-30)
        edge = np.partition(d2, m - 1, axis=1)[:, m - 1] + slack
        out_q, out_p, out_d = [], [], []
        for i in range(len(part)):
            # all rows within rounding of the k-th, then exact distances
            near = np.flatnonzero(d2[i] <= min(edge[i], np.finfo(float).max))
            exact = np.sqrt(((p[near] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((pid[near], exact))[:k]
            out_q.append(np.full(len(best), qid[a + i]))
            out_p.append(pid[near][best])
            out_d.append(exact[best])
        yield pd.DataFrame({"qid": np.concatenate(out_q), "pid": np.concatenate(out_p), "distance": np.concatenate(out_d)})


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "pid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame, points: DataFrame, k: int = 5, skip_same: bool = False,
    small_side: int = SMALL_SIDE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(qid, pid, distance, rank): the k nearest points of every query, exact.

    queries: (id bigint, v array<double>), points the same. `skip_same` leaves out equal ids.
    """
    schema = "qid bigint, pid bigint, distance double"
    n = points.limit(small_side + 1).count()
    if n <= small_side:
        held = points.select("id", "v").toPandas()
        pid, p = held["id"].to_numpy(), _matrix(held["v"])
        sent = points.sparkSession.sparkContext.broadcast((pid, p))

        def near_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, rows = sent.value
            for b in batches:
                yield from _nearest(b["id"].to_numpy(), _matrix(b["v"]), ids, rows, k, skip_same)

        return _ranked(queries.select("id", "v").mapInPandas(near_small, schema), k)
    return _knn_blocks(queries.select("id", "v"), points.select("id", "v"), k, skip_same, block_rows, schema)


def _knn_blocks(queries: DataFrame, points: DataFrame, k: int, skip_same: bool, block: int, schema: str) -> DataFrame:
    spark = points.sparkSession
    total = points.count()
    m = int(min(MAX_PIVOTS, max(2, total ** 0.5 / 8)))
    pivots = _matrix(points.orderBy(F.xxhash64("id"), "id").limit(m).toPandas()["v"])
    sent = spark.sparkContext.broadcast(pivots)

    def to_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["v"])
            cell = np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)
            b["cell"], b["reach"] = cell.astype("int32"), np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
            yield b

    placed = "id bigint, v array<double>, cell int, reach double"
    q, p = queries.mapInPandas(to_cell, placed), points.mapInPandas(to_cell, placed)
    # per cell: sizes, radii and the k points closest to the pivot; a few rows per pivot
    kk = k + 1 if skip_same else k
    q_cells = q.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("r")).toPandas()
    p_cells = p.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    w = Window.partitionBy("cell").orderBy("reach")
    closest = p.select("cell", "reach").withColumn("k", F.row_number().over(w)).where(F.col("k") <= kk).toPandas()
    gap = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0))
    p_n = dict(zip(p_cells["cell"], p_cells["n"]))
    plan = []
    for cell, n_q, radius in q_cells.itertuples(index=False):
        upper = np.sort(radius + gap[cell, closest["cell"]] + closest["reach"].to_numpy())
        bound = upper[min(kk, len(upper)) - 1] * (1 + 1e-9) + 1e-12
        for other in p_n:
            low = gap[cell, other] - radius - bound
            high = gap[cell, other] + radius + bound
            plan.append((int(cell), int(other), float(low), float(high), int(-(-n_q // block))))
    rules = pd.DataFrame(plan, columns=["q_cell", "cell", "low", "high", "q_blocks"])
    # point blocks per query cell, from the sizes of the point cells it may need
    need = rules.assign(n=rules["cell"].map(p_n)).groupby("q_cell")["n"].sum()
    rules["p_blocks"] = rules["q_cell"].map(lambda c: int(-(-need[c] // block)))
    rule_rows = spark.createDataFrame(rules)
    per_cell = spark.createDataFrame(rules[["q_cell", "q_blocks", "p_blocks"]].drop_duplicates())
    h = lambda c, n: F.pmod(F.xxhash64(c, F.lit(17)), F.col(n)).cast("int")
    # both sides' keys are of one type: Spark sends an int and an equal bigint to different tasks
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = q.join(F.broadcast(per_cell), q["cell"] == per_cell["q_cell"]).select(  # at most MAX_PIVOTS rows
        "id", "v", "q_cell", h("id", "q_blocks").alias("qb"), upto("p_blocks").alias("pb"))
    right = p.join(F.broadcast(rule_rows), "cell").where(  # at most MAX_PIVOTS squared rows
        (F.col("reach") >= F.col("low")) & (F.col("reach") <= F.col("high")))
    right = right.select(
        "id", "v", "q_cell", upto("q_blocks").alias("qb"), h("id", "p_blocks").alias("pb"))

    def near_block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(_nearest(a["id"].to_numpy(), _matrix(a["v"]), b["id"].to_numpy(), _matrix(b["v"]), k, skip_same))
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "pid": [], "distance": []})

    key = ["q_cell", "qb", "pb"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(near_block, schema)
    return _ranked(pairs, k)


def label_distance_sums(points: DataFrame, labelings: int, small_side: int = SMALL_SIDE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, labeling, label, total): sum of Euclidean distances from each row to all rows of each label.

    points: (id bigint, v array<double>, labels array<int>), one label per labeling;
    a negative label leaves the row out of that labeling. A task holds one block of rows and
    sees all rows stream past, so only finished sums leave it.
    """
    schema = "id bigint, labeling int, label int, total double"
    rows = points.select("id", "v", "labels")
    total = rows.count()
    if total <= small_side:
        held = rows.toPandas()
        sent = points.sparkSession.sparkContext.broadcast((_matrix(held["v"]), np.array(held["labels"].tolist())))

        def sums_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, labels = sent.value
            for b in batches:
                if len(b):
                    ids, sums = b["id"].to_numpy(), {}
                    _add_sums(sums, _matrix(b["v"]), p, labels, labelings)
                    yield from _sum_rows(ids, sums)

        return rows.mapInPandas(sums_small, schema)
    # large blocks spare copies of the rows, many blocks keep all tasks busy on a middling table
    blocks = int(max(-(-total // (8 * block_rows)), min(LEAST_BLOCKS, -(-8 * total // block_rows))))
    own = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(blocks)).cast("int")
    block = rows.select(own.alias("block"), F.lit(0).alias("side"), "*")
    stream = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "*")
    # told by number, the tasks are not merged for their few bytes: their work is far larger
    met = block.unionByName(stream).repartitionById(blocks, "block").sortWithinPartitions("side")

    def sums_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, sums = [], [], {}
        for b in batches:
            first = b[b["side"] == 0]
            if len(first):
                ids.append(first["id"].to_numpy())
                q.append(_matrix(first["v"]))
            rest = b[b["side"] == 1]
            if not len(rest) or not q:
                continue
            ids, q = [np.concatenate(ids)], [np.concatenate(q)]
            _add_sums(sums, q[0], _matrix(rest["v"]), np.array(rest["labels"].tolist()), labelings)
            if len(sums) * len(q[0]) > SUM_CELLS:
                yield from _sum_rows(ids[0], sums)
                sums = {}
        if sums:
            yield from _sum_rows(ids[0], sums)

    parts = met.drop("block").mapInPandas(sums_block, schema)
    return parts.groupBy("id", "labeling", "label").agg(F.sum("total").alias("total"))


def _add_sums(sums: dict[tuple[int, int], np.ndarray], q: np.ndarray, p: np.ndarray, labels: np.ndarray, labelings: int) -> None:
    """Add to (labeling, label) the distances from each row of q to the rows of p with that label."""
    keys, hot = [], []
    for j in range(labelings):
        names = np.unique(labels[:, j])
        names = names[names >= 0]
        keys += [(j, int(n)) for n in names]
        hot.append((labels[:, j][:, None] == names[None, :]).astype(float))
    hot = np.concatenate(hot, axis=1)
    p2 = (p * p).sum(axis=1)
    rounding = 1e-7 * (p2 + 1e-30)
    step = max(1, DISTANCE_CELLS // len(p))
    out = np.empty((len(q), len(keys)))
    for a in range(0, len(q), step):
        part = q[a:a + step]
        d = part @ (-2 * p.T)
        d += (part * part).sum(axis=1)[:, None]
        d += p2
        # distances at rounding level are recomputed, so a row's distance to its copies is exactly zero
        tiny = np.argwhere(d < rounding)
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        if len(tiny):
            i, j = tiny[:, 0], tiny[:, 1]
            d[i, j] = np.sqrt(((part[i] - p[j]) ** 2).sum(axis=1))
        out[a:a + step] = d @ hot
    for i, key in enumerate(keys):
        sums[key] = sums[key] + out[:, i] if key in sums else out[:, i].copy()


def _sum_rows(ids: np.ndarray, sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pd.DataFrame]:
    for (j, name), total in sums.items():
        yield pd.DataFrame({"id": ids, "labeling": np.full(len(ids), j, dtype="int32"), "label": np.full(len(ids), name, dtype="int32"), "total": total})
