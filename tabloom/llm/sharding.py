"""Two-pass external shuffle into shards (DataFrame functions only).

Pass one scatters rows by seeded hashes: the shard is the one whose hash with the document id is highest, so a row moves
only when a new shard wins it (law `key`), and inside its shard a second hash picks one of B buckets, with B set from
the total size and number of rows so that a bucket is small. Pass two loads one bucket at a time, shuffles it by Fisher-Yates
from a defined start order, and numbers the rows; every swap is drawn from a hash of (seed, shard, bucket, step), so slots
depend on neither partitions nor task attempts. Small per-bucket counts give each bucket its first slot. No step holds
more than one bucket, however large a shard is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.base import boxed, stored
from tabloom.session import scratch

SHARDS = 24
BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 2048
SEED = 17


def winner(key: Column, shards: int, seed: int = SEED) -> Column:
    """Shard of `key` among 0..shards-1 by highest hash; equal hashes go to the higher shard."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*scores)["s"]


def fisher_yates(n: Column, *seed: Column) -> Column:
    """A permutation of 0..n-1: from the last place down, each swaps with a hashed place at or before it."""

    def swapped(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seed, i), i + 1).cast("int")
        parts = [F.slice(order, 1, j), F.array(F.get(order, i)), F.slice(order, j + 2, i - j - 1), F.array(F.get(order, j)), F.slice(order, i + 2, n - i - 1)]
        return F.when(i == j, order).otherwise(F.concat(*parts))

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), n - 1), swapped)


def shuffled(
    rows: DataFrame, key: str, size: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Columns `row` (all input columns), shard, slot and grown_shard.

    Slots run from 0 without gaps in every shard. Rows with equal or null keys share a shard and are spread over its
    buckets by all their columns; rows equal in every column share a bucket. An empty table gives an empty result.
    `rows` is read twice, so it should be a stored table.
    """
    total, count = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // (bucket_bytes * shards)), -(-count // (bucket_rows * shards)))
    spread = [F.col(f"row.`{c}`") for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    placed = boxed(rows).select(
        "row",
        winner(F.col(f"row.`{key}`"), shards, seed).alias("shard"),
        winner(F.col(f"row.`{key}`"), shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), *spread), F.lit(buckets)).alias("bucket"),
        F.xxhash64(F.lit(seed + 2), *spread).alias("start"),
    )
    groups = placed.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct("start", "grown_shard", "row"))).alias("rows"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = fisher_yates(F.size("rows"), F.lit(seed + 3), F.col("shard"), F.col("bucket"))
    mixed = groups.join(first, ["shard", "bucket"]).select("shard", "first", F.transform(order, lambda i: F.get("rows", i)).alias("rows"))
    return mixed.select("shard", "first", F.posexplode("rows").alias("at", "r")).select(
        "r.row", "shard", (F.col("first") + F.col("at")).alias("slot"), "r.grown_shard"
    )


def sized(docs: DataFrame) -> DataFrame:
    """The documents with their size (UTF-8 bytes and 8 more, a null text has no bytes) as `_size`."""
    return docs.withColumn("_size", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 8)


def _write(placed: DataFrame, columns: list[Column], path: str) -> None:
    rows = placed.select(*columns, "shard", "slot")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The placement of every document under the law `key`, read back from the written shards.

    The whole documents go through both passes; sizes and checksums are those of the texts that arrived. A null text has no
    bytes and the checksum 0. `docs` is read as often as `shuffled` needs it and not copied before.
    """
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    whole = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).alias("row")
    placed = shuffled(sized(docs), "doc_id", "_size", shards, seed, bucket_bytes)
    out = placed.select(whole, "shard", "slot", "grown_shard")
    _write(out, [F.col("row"), F.col("grown_shard")], path)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return spark.read.schema(out.schema).parquet(path).select(
        "row.doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write whole documents as `path/shard=K/...` in shuffled order.

    Files of a shard are numbered by bucket, and rows inside a file stand in slot order.
    """
    placed = shuffled(stored(sized(docs), "sized"), "doc_id", "_size", shards, seed, bucket_bytes)
    _write(placed, [F.col(f"row.`{c}`").alias(c) for c in docs.columns], path)
