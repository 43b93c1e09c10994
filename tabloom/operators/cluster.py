"""Clustering: a k-means sweep in shared passes, exact DBSCAN on a grid, quality scores."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import row_positions
from tabloom.operators import planar, prep
from tabloom.operators.neighbors import BLOCK_ROWS, SMALL_SIDE, _matrix, label_distance_sums
from tabloom.session import beside, checkpointed, maybe_broadcast, small_enough, training_tasks, values_frame, written

K_RANGE = (2, 10)
RESTARTS = 10
SEED_ROUNDS = 5  # oversampling rounds over all rows before the k-means++ starts
MAX_PASSES = 300
ROWS_PER_TASK, MOST_ROWS = 10_000, 200_000  # of a pass
PASS_CELLS = 100_000  # distances a task holds at once: few enough for its cache


def scaled_vectors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, v) with standard-scaled columns."""
    fitted = prep.fit_standard(df, columns)
    return prep.scale(df, fitted).select(F.col(key).cast("bigint").alias("id"), F.array(*columns).alias("v"))


# ---- k-means ----

def _plus_plus(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = [x[rng.choice(len(x), p=weight / weight.sum())]]
    d2 = ((x - centers[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        mass = d2 * weight
        p = mass / mass.sum() if mass.sum() > 0 else None
        centers.append(x[rng.choice(len(x), p=p)])
        d2 = np.minimum(d2, ((x - centers[-1]) ** 2).sum(axis=1))
    return np.array(centers)


def _candidates(points: DataFrame, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start candidates and how many rows each stands for, by k-means||.

    Every round reads all rows and keeps each with probability `size` times its share of the squared distance to the
    candidates so far; about `size` rows a round are expected, whatever the number of rows.
    """
    first = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).toPandas()
    found = _matrix(first["v"])
    for turn in range(SEED_ROUNDS):
        near = points.select("id", "v", _nearest_of(found)("v")["d"].alias("d2"))
        total = near.agg(F.sum("d2")).first()[0]
        if not total:
            break
        u = F.pmod(F.xxhash64("id", F.lit(seed + 1 + turn)), F.lit(1 << 40)) / float(1 << 40)
        kept = near.where(u < F.col("d2") * (size / total)).toPandas()["v"]
        found = np.concatenate([found, _matrix(kept)]) if len(kept) else found
    counts = {r["label"]: r["count"] for r in points.groupBy(_nearest_of(found)("v")["i"].alias("label")).count().collect()}
    return found, np.array([counts.get(i, 0) for i in range(len(found))], dtype=float)


def kmeans_runs(points: DataFrame, ks: list[int], restarts: int = RESTARTS, seed: int = 42, tol: float = 1e-4) -> dict[int, tuple[float, np.ndarray]]:
    """{k: (inertia, centers)} of the best restart per k.

    All runs of all k share each pass over the data: tasks send back one partial sum
    per center, the driver holds only the centers.
    """
    start, weight = _candidates(points, 2 * max(ks), seed)
    rng = np.random.default_rng(seed)
    runs = [(k, _plus_plus(start, weight, k, rng)) for k in ks for _ in range(restarts)]
    inertia = [math.inf] * len(runs)
    spread = points.agg(F.array(*[F.var_pop(F.col("v")[i]) for i in range(start.shape[1])]).alias("v")).first()["v"]
    limit = tol * float(np.mean(spread))
    live = list(range(len(runs)))
    blocks = _blocks(points)
    for _ in range(MAX_PASSES):
        sums = _pass(blocks, {r: runs[r][1] for r in live})
        still = []
        for r in live:
            k, old = runs[r]
            count, total, cost = sums[r]
            new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], old)
            inertia[r] = cost
            runs[r] = (k, new)
            if ((new - old) ** 2).sum() > limit:
                still.append(r)
        live = still
        if not live:
            break
    final = _pass(blocks, {r: runs[r][1] for r in range(len(runs))})
    blocks.unpersist()
    best: dict[int, tuple[float, np.ndarray]] = {}
    for r, (k, centers) in enumerate(runs):
        cost = final[r][2]
        if k not in best or cost < best[k][0]:
            best[k] = (cost, centers)
    return best


def _blocks(points: DataFrame) -> DataFrame:
    """Persisted rows as blocks of bytes: a pass reads them without converting single numbers."""

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"])
                yield pd.DataFrame({"x": [x.tobytes()], "dim": [x.shape[1]]})

    tasks = training_tasks(points.sparkSession, points.count(), ROWS_PER_TASK, MOST_ROWS)
    return points.select("id", "v").repartition(tasks, "id").mapInPandas(block, "x binary, dim int").persist()


def _pass(blocks: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """{run: (rows, sums, cost)} per center; the runs with most centers come first, so that all with a j-th one are neighbours."""
    order = sorted(centers, key=lambda r: -len(centers[r]))
    most, n = len(centers[order[0]]), len(order)
    rows = [np.array([centers[r][j] for r in order if len(centers[r]) > j]) for j in range(most)]
    dim = rows[0].shape[1]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((dim + 2, n * most))
        for held, d in ((h, d) for b in batches for h, d in zip(b["x"], b["dim"])):
            whole = np.frombuffer(held).reshape(-1, d)
            step = max(1, PASS_CELLS // n)
            for a in range(0, len(whole), step):
                x = whole[a:a + step]
                best, own = np.full((len(x), n), np.inf), np.zeros((len(x), n), dtype=np.int64)
                for j, c in enumerate(rows):
                    d2 = x @ (-2 * c.T)
                    d2 += (c * c).sum(axis=1)
                    less = d2 < best[:, :len(c)]
                    np.copyto(best[:, :len(c)], d2, where=less)
                    np.copyto(own[:, :len(c)], j, where=less)
                best += (x * x).sum(axis=1)[:, None]
                own += np.arange(n) * most
                own = own.ravel()
                out[0] += np.bincount(own, minlength=n * most)
                out[1] += np.bincount(own, np.maximum(best, 0).ravel(), n * most)
                for i in range(dim):
                    out[2 + i] += np.bincount(own, np.repeat(x[:, i], n), n * most)
        yield pd.DataFrame({"sums": [out.tobytes()]})

    parts = blocks.mapInPandas(partial, "sums binary").collect()  # a few numbers per center and task
    sums = np.sum([np.frombuffer(r["sums"]).reshape(dim + 2, n, most) for r in parts], axis=0)
    return {r: (sums[0, i, :len(centers[r])], sums[2:, i, :len(centers[r])].T, float(sums[1, i].sum())) for i, r in enumerate(order)}


def _closest(v: Column, centers: np.ndarray) -> Column:
    """(d, i): squared distance and index of the closest center, as a JVM expression; ties to the lower index."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])

    def measure(c: Column, i: Column) -> Column:
        d = F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return F.struct(d.alias("d"), i.cast("int").alias("i"))

    return F.array_min(F.transform(table, measure))


def _nearest_of(centers: np.ndarray):
    """UDF with the fields of `_closest`, for very many centers."""

    @F.pandas_udf("d double, i int")
    def measure(v: pd.Series) -> pd.DataFrame:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
        d, at = np.empty(len(x)), np.empty(len(x), dtype=np.int32)
        for a in range(0, len(x), 1024):
            part = x[a:a + 1024]
            d2 = sum(np.subtract.outer(part[:, i], c) ** 2 for i, c in enumerate(centers.T))
            at[a:a + 1024] = d2.argmin(axis=1)
            d[a:a + 1024] = d2[np.arange(len(part)), at[a:a + 1024]]
        return pd.DataFrame({"d": d, "i": at})

    return measure


def nearest_center(v: Column, centers: np.ndarray) -> Column:
    return _closest(v, centers)["i"]


def cluster_assign(points: DataFrame, centers: np.ndarray) -> DataFrame:
    return points.withColumn("label", nearest_center(F.col("v"), centers))


def kmeans_sweep(
    points: DataFrame, k_range: tuple[int, int] = K_RANGE, restarts: int = RESTARTS, seed: int = 42,
    include_dbscan: bool = True, eps: float = 0.5, min_samples: int = 5,
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Model table (model, n_clusters, inertia, silhouette, calinski_harabasz, davies_bouldin, n_noise, best) and the centers.

    The silhouettes of all k come from one blocked pass over the pairs.
    """
    points = points.persist()
    ks = list(range(k_range[0], k_range[1] + 1))
    runs = kmeans_runs(points, ks, restarts, seed)
    labels = [nearest_center(F.col("v"), runs[k][1]) for k in ks]
    names, inertias = [f"kmeans_{k}" for k in ks], [float(runs[k][0]) for k in ks]
    labelled = points.select("id", "v", *[c.cast("int").alias(f"l{i}") for i, c in enumerate(labels)])
    if include_dbscan:
        dim = len(points.select("v").first()["v"])
        d = dbscan(points.select("id", *[F.col("v")[i].alias(f"x{i}") for i in range(dim)]), "id",
                   [f"x{i}" for i in range(dim)], eps, min_samples)
        labelled = labelled.join(d.select("id", F.col("label").cast("int").alias(f"l{len(ks)}")), "id")
        names.append("dbscan")
        inertias.append(None)
    table = labelled.select("id", "v", F.array(*[f"l{i}" for i in range(len(names))]).alias("labels")).persist()
    scores = silhouette(table, len(names))
    shape = cluster_shape(table, len(names))
    noise = table.select(F.posexplode("labels").alias("labeling", "label")).groupBy("labeling").agg(
        F.count_if(F.col("label") < 0).alias("n_noise"))  # one row per model
    meta = values_frame(points.sparkSession, list(zip(range(len(names)), names, inertias)), "labeling int, model string, inertia double")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("silhouette"), "labeling")  # one row per model
    out = meta.join(F.broadcast(scores), "labeling", "left").join(F.broadcast(shape), "labeling", "left").join(
        F.broadcast(noise), "labeling", "left")
    out = out.withColumns({"silhouette": F.coalesce("silhouette", F.lit(-1.0)), "calinski_harabasz": F.coalesce("calinski_harabasz", F.lit(0.0)),
                           "davies_bouldin": F.coalesce("davies_bouldin", F.lit(float("inf"))), "n_clusters": F.coalesce("n_clusters", F.lit(0))})
    return out.withColumn("best", F.row_number().over(w) == 1).drop("labeling"), {k: c for k, (_, c) in runs.items()}


# ---- quality ----

def silhouette(points: DataFrame, labelings: int = 1, small_side: int = SMALL_SIDE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(labeling, silhouette): mean over all rows, exact Euclidean; negative labels are left out.

    points: (id, v, labels array<int>). Many rows with at most two columns are summed through squares of the plane; else
    the work is quadratic in the rows, so it is cut into pairs of blocks. Nothing is sampled.
    """
    own = points.select("id", F.posexplode("labels").alias("labeling", "own")).where(F.col("own") >= 0)
    sizes = own.groupBy("labeling", F.col("own").alias("label")).agg(F.count("*").alias("n"))
    if not small_enough(points, small_side) and small_enough(sizes, planar.MOST_LABELS):
        scores = planar.silhouettes(points, labelings, [tuple(r) for r in sizes.collect()])
        if scores is not None:
            return scores
    sums = label_distance_sums(points, labelings, small_side, block_rows)
    joined = sums.join(maybe_broadcast(sizes), ["labeling", "label"]).join(own, ["id", "labeling"])
    same = F.col("label") == F.col("own")
    per = joined.groupBy("id", "labeling").agg(
        F.max(F.when(same, F.try_divide("total", F.col("n") - 1))).alias("a"),
        F.max(F.when(same, F.col("n"))).alias("n"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    # one cluster only: no score
    return per.where(F.col("b").isNotNull()).groupBy("labeling").agg(F.avg(s).alias("silhouette"))


def _means(points: DataFrame) -> DataFrame:
    """(labeling, label, dim, mean, n) and through it every center."""
    long = points.select("id", "v", F.posexplode("labels").alias("labeling", "label")).where(F.col("label") >= 0)
    cells = long.select("labeling", "label", F.posexplode("v").alias("dim", "x"))
    return cells.groupBy("labeling", "label", "dim").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def cluster_shape(points: DataFrame, labelings: int = 1) -> DataFrame:
    """(labeling, n_clusters, calinski_harabasz, davies_bouldin) from the centers and one pass."""
    means = checkpointed(_means(points))  # clusters x dimensions rows
    centers = means.groupBy("labeling", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("center"), F.max("n").alias("n"))
    whole = means.groupBy("labeling", "dim").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("m"))
    whole = whole.groupBy("labeling").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("middle"))

    def d2(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    long = points.select("id", "v", F.posexplode("labels").alias("labeling", "label")).where(F.col("label") >= 0)
    near = long.join(maybe_broadcast(centers), ["labeling", "label"])
    inner = near.groupBy("labeling", "label").agg(
        F.sum(d2("v", "center")).alias("within"), F.avg(F.sqrt(d2("v", "center"))).alias("spread"))
    c = centers.join(inner, ["labeling", "label"]).join(whole, "labeling")
    ch = c.groupBy("labeling").agg(
        F.count("*").alias("n_clusters"), F.sum("n").alias("rows"),
        F.sum(F.col("n") * d2("center", "middle")).alias("between"), F.sum("within").alias("within"))
    k = F.col("n_clusters")
    ch = ch.withColumn("calinski_harabasz", F.when(k > 1, F.coalesce(
        F.try_divide(F.col("between") * (F.col("rows") - k), F.col("within") * (k - 1)), F.lit(1.0))))
    other = c.select("labeling", F.col("label").alias("label2"), F.col("center").alias("center2"), F.col("spread").alias("spread2"))
    pairs = c.join(other, (c["labeling"] == other["labeling"]) & (F.col("label") != F.col("label2"))).drop(other["labeling"])
    worst = pairs.groupBy("labeling", "label").agg(
        F.max(F.try_divide(F.col("spread") + F.col("spread2"), F.sqrt(d2("center", "center2")))).alias("r"))
    db = worst.groupBy("labeling").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("davies_bouldin"))
    return ch.join(db, "labeling", "left").select("labeling", "n_clusters", "calinski_harabasz", "davies_bouldin")


# ---- DBSCAN ----

#: Cells around a cell are looked up by the coordinates of the first columns; the others are compared after the join.
GRID_COLUMNS = {1: 1, 2: 2, 3: 3, 4: 4}


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(key, label): exact DBSCAN, noise -1, clusters numbered by their smallest core key.

    Cells have diagonal eps, so every row of a cell with `min_samples` rows is a core
    row and the cell is one graph node, however many rows it holds. Rows of sparser
    cells (fewer than `min_samples` each) are compared with the rows around them. Two
    full cells are linked by comparing bounding boxes of ever smaller parts.
    """
    d = len(columns)
    k = GRID_COLUMNS.get(d, 2)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    xs = [f"x{i}" for i in range(d)]
    cs = [f"c{i}" for i in range(d)]
    pts = df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs)])
    pts = pts.withColumns({c: F.floor(F.col(x) / side).cast("bigint") for c, x in zip(cs, xs)})
    sizes = pts.groupBy(*cs).agg(F.count("*").alias("n"), F.min("id").alias("low_id"))
    sizes = checkpointed(sizes.withColumn("full", F.col("n") >= min_samples))
    pts = checkpointed(pts.join(maybe_broadcast(sizes.select(*cs, "full")), cs))

    reach = math.ceil(math.sqrt(d))
    steps = [o for o in itertools.product(range(-reach, reach + 1), repeat=k) if sum(max(abs(v) - 1, 0) ** 2 for v in o) < d]
    offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in steps])
    shifted = [(F.col(c) + F.col("o")[i]).alias(c) for i, c in enumerate(cs[:k])]

    # sparse rows against the rows of the cells around them
    sparse = pts.where(~F.col("full"))
    probes = sparse.withColumn("o", F.explode(offsets)).select(
        F.col("id").alias("p"), *[F.col(x).alias(f"p{x}") for x in xs], *shifted)
    probes = probes.join(maybe_broadcast(sizes.select(*cs[:k]).distinct()), cs[:k], "left_semi")
    close = sum(((F.col(x) - F.col(f"p{x}")) * (F.col(x) - F.col(f"p{x}")) for x in xs), F.lit(0.0)) <= eps * eps
    met = pts.join(probes, cs[:k]).where(close)
    # partial counts per full cell, single rows from sparse cells
    near = met.groupBy("p", "full", *cs, F.when(~F.col("full"), F.col("id")).alias("q")).agg(F.count("*").alias("n"))
    near = checkpointed(near)
    core = near.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select(F.col("p").alias("id"))
    core = checkpointed(core)

    cell_node = F.struct(F.lit(0).alias("kind"), F.col("low_id").alias("id"))
    row_node = lambda c: F.struct(F.lit(1).alias("kind"), F.col(c).alias("id"))
    full = sizes.where("full").select(*cs, "low_id")
    from_core = near.join(maybe_broadcast(core), near["p"] == core["id"], "left_semi")
    to_cell = from_core.where("full").join(maybe_broadcast(full), cs).select(row_node("p").alias("a"), cell_node.alias("b"))
    to_row = from_core.where("NOT full").join(maybe_broadcast(core), F.col("q") == core["id"], "left_semi").select(
        row_node("p").alias("a"), row_node("q").alias("b"))
    links = _cell_links(pts.where("full"), full, offsets, shifted, cs, k, xs, side, eps)
    edges = to_cell.unionByName(to_row).unionByName(links)
    nodes = full.select(cell_node.alias("a"), F.col("low_id").alias("first")).unionByName(
        core.select(row_node("id").alias("a"), F.col("id").alias("first")))
    comp = checkpointed(_components(nodes, edges))  # (a, first): smallest core key of the component
    numbered = row_positions(comp.select("first").distinct(), [], ["first"], "label")
    comp = checkpointed(comp.join(maybe_broadcast(numbered), "first").select("a", "label"))

    cells = full.join(comp, comp["a"] == cell_node).select(*cs, F.col("label").alias("cell_label"))
    in_cells = pts.where("full").join(maybe_broadcast(cells), cs).select("id", F.col("cell_label").alias("label"))
    rows = comp.where("a.kind = 1").select(F.col("a.id").alias("id"), "label")
    # border rows: lowest cluster among the core rows in reach
    border = near.join(maybe_broadcast(core), near["p"] == core["id"], "left_anti")
    by_cell = border.where("full").join(maybe_broadcast(cells), cs).select("p", F.col("cell_label").alias("label"))
    by_row = border.where("NOT full").join(maybe_broadcast(rows), F.col("q") == rows["id"]).select("p", "label")
    reached = by_cell.unionByName(by_row).groupBy(F.col("p").alias("id")).agg(F.min("label").alias("label"))
    named = in_cells.unionByName(rows).unionByName(reached)
    return pts.select("id").join(named, "id", "left").select(
        F.col("id").alias(key), F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def _cell_links(points, full, offsets, shifted, cs, k, xs, side, eps) -> DataFrame:
    """Edges between full cells whose closest rows are within eps."""
    spark = points.sparkSession
    ordered = F.struct(*cs)
    far = full.withColumn("o", F.explode(offsets)).select(
        F.col("low_id").alias("a"), F.struct(*cs).alias("own"), *shifted)
    gap = sum((F.pow(F.greatest(F.abs(F.col(f"own.{c}") - F.col(c)) - 1, F.lit(0)), F.lit(2)) for c in cs), F.lit(0.0))
    pairs = far.join(full, cs[:k]).where((F.col("own") < ordered) & (gap < len(cs))).select("a", F.col("low_id").alias("b"))
    edge_schema = "a struct<kind:int,id:bigint>, b struct<kind:int,id:bigint>"
    node = lambda c: F.struct(F.lit(0).alias("kind"), F.col(c).cast("bigint").alias("id"))
    owned = checkpointed(points.join(maybe_broadcast(full), cs).select(F.col("low_id").alias("cell"), *xs))

    def boxes(level: int, wanted: DataFrame) -> DataFrame:
        part = [F.floor(F.col(x) / (side / 2 ** level)).cast("bigint") for x in xs]
        up = [F.floor(F.col(x) / (side / 2 ** (level - 1))).cast("bigint") for x in xs] if level else [F.lit(0).cast("bigint") for _ in xs]
        kept = owned.join(maybe_broadcast(wanted), "cell", "left_semi")
        sides = [e for x in xs for e in (F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}"))]
        return kept.groupBy("cell", F.array(*up).alias("up"), F.array(*part).alias("part")).agg(*sides)

    lows = [f"lo_{x}" for x in xs] + [f"hi_{x}" for x in xs]
    least = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo_{x}") - F.col(f"hi_{x}"), F.col(f"lo_{x}") - F.col(f"b_hi_{x}")), F.lit(2.0)) for x in xs), F.lit(0.0))
    most = sum((F.pow(F.greatest(F.col(f"b_hi_{x}") - F.col(f"lo_{x}"), F.col(f"hi_{x}") - F.col(f"b_lo_{x}")), F.lit(2.0)) for x in xs), F.lit(0.0))
    zero = F.array(*[F.lit(0).cast("bigint") for _ in xs])
    open_pairs = pairs.select("a", "b", zero.alias("pa"), zero.alias("pb"))
    found = spark.createDataFrame([], edge_schema)
    for level in range(0, 64):
        if open_pairs.isEmpty():
            return found
        wanted = open_pairs.select(F.col("a").alias("cell")).union(open_pairs.select("b")).distinct()
        box = boxes(level, wanted)
        left = box.select(F.col("cell").alias("a"), F.col("up").alias("pa"), F.col("part").alias("na"), *lows)
        right = box.select(F.col("cell").alias("b"), F.col("up").alias("pb"), F.col("part").alias("nb"), *[F.col(c).alias(f"b_{c}") for c in lows])
        met = open_pairs.join(left, ["a", "pa"]).join(right, ["b", "pb"]).select("*", least.alias("least"), most.alias("most"))
        met = met.where(F.col("least") <= eps * eps)
        state = checkpointed(met.select("a", "b", "na", "nb", (F.col("most") <= eps * eps).alias("sure")))
        linked = state.where("sure").select("a", "b").distinct()
        found = checkpointed(found.unionByName(linked.select(node("a").alias("a"), node("b").alias("b"))))
        open_pairs = state.join(maybe_broadcast(linked), ["a", "b"], "left_anti").select(
            "a", "b", F.col("na").alias("pa"), F.col("nb").alias("pb"))
    raise RuntimeError("cell boxes did not separate")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, first): smallest `first` over each connected component, by rounds of neighbour minimum and shortcut."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    state = written(nodes.select("a", "first"), "state")
    owner = written(nodes.select(F.col("a").alias("o"), F.col("first").alias("home")), "owner")
    while True:
        heard = both.join(state.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("first").alias("heard"))
        step = state.join(heard, "a", "left").select("a", "first", F.least("first", F.coalesce("heard", F.col("first"))).alias("new"))
        # shortcut: the label's home node may already know a smaller one
        known = step.join(owner, step["a"] == owner["o"]).select(F.col("home").alias("h"), F.col("new").alias("jump"))
        jumped = step.join(known, step["new"] == known["h"], "left").select(
            "a", "first", F.least("new", F.coalesce("jump", F.col("new"))).alias("new"))
        jumped = written(jumped, "state")
        changed = not jumped.where(F.col("new") < F.col("first")).isEmpty()
        state = jumped.select("a", F.col("new").alias("first"))
        if not changed:
            return state
