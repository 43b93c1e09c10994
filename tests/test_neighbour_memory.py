"""The neighbour search holds few distances at once, whatever the size of a block."""

import tracemalloc

import numpy as np

from pyspark.sql import functions as F

from tabloom.operators.neighbors import BLOCK_ROWS, _nearest, knn_join


def test_a_block_is_searched_in_little_memory():
    rng = np.random.default_rng(0)
    q, p = rng.normal(size=(600, 8)), rng.normal(size=(BLOCK_ROWS, 8))
    tracemalloc.start()
    found = list(_nearest(np.arange(600), q, np.arange(BLOCK_ROWS), p, 3, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    got = np.concatenate([f["pid"].to_numpy() for f in found]).reshape(600, 3)
    want = np.argsort(((q[:, None, :] - p[None]) ** 2).sum(axis=2), axis=1)[:, :3]
    assert (got == want).all()


def test_blocks_meet_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(600).select("id", F.array(*[(F.xxhash64("id", F.lit(i)) % 1000) / 100.0 for i in range(3)]).alias("v"))
        queries = rows.where("id % 5 = 0")
        want = sorted(map(tuple, knn_join(queries, rows, 3).collect()))
        got = sorted(map(tuple, knn_join(queries, rows, 3, small_side=10, block_rows=40).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(want) == 360 and [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
