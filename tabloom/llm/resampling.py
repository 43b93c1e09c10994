"""Importance resampling towards a target distribution, drawn by a distributed radix sort.

1. Features (runs of words) are counted in hashed buckets, once over the documents and once over the target texts. A
   task adds up one array of counts whatever it reads.
2. The gain of a bucket is the logarithm of its smoothed rates, target over source. The gains are one short array, so a
   document's weight is a sum of array items.
3. A Gumbel number seeded by the document is added; the highest scores are a draw without replacement in proportion to
   the exponential of the weights.
4. Scores are ranked by a least-significant-digit radix sort over the composite key (score downwards, document, features).
   A pass is a stable counting sort: counts per (block, digit), their prefix sums over digits and blocks, and each row's
   own place inside its cell give the row's destination, and destinations are cut into blocks of bounded size for
   the next pass. No step orders more than one block's rows of one digit, and ties of any number are as good as any rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.base import map_batches, stored

BUCKETS = 10_000
#: Longest feature in words, the seed of the draw, the share drawn in percent and the least words of a drawn document.
WIDEST = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bits of a digit, and the most rows of a block.
BITS = 11
BLOCK = 1 << 17

#: Bytes outside a word become spaces, and A-Z lower case; bytes from 0x80 on are parts of letters.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


class FeatureBuckets(dict):
    """Bucket of each feature seen so far, in a table of bounded size."""

    LIMIT = 200_000

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value

    def of(self, text: str | None, widest: int) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of all runs of 1 to `widest` words."""
        words = text.encode("utf-8", "replace").translate(_TABLE).split() if text else []
        features = list(words)
        for k in range(2, widest + 1):
            features += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        return len(words), np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, widest: int = WIDEST) -> DataFrame:
    """(bucket, n) over the column `text`: features of all rows; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = FeatureBuckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                found = [table.of(t, widest)[1] for t in batch.column("text").slice(start, 64).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, widest: int = WIDEST) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed rates of each bucket; `buckets` numbers, whatever the input."""
    spark = docs.sparkSession
    s = bucket_counts(docs, buckets, widest).withColumnRenamed("n", "s")
    t = bucket_counts(target, buckets, widest).withColumnRenamed("n", "t")
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    both = stored(both, "buckets")
    total = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (F.col("all_s") + buckets)) / ((d("s") + 1) * (F.col("all_t") + buckets))
    # the totals are a global aggregate: one row
    rows = both.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.gain for r in rows]
    return out


def weighted(docs: DataFrame, gain: np.ndarray, widest: int = WIDEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of `docs`."""

    def run(batch: dict[str, list], table: FeatureBuckets) -> dict[str, list]:
        n_words, n_features, weight = [], [], []
        for text in batch["text"]:
            n, found = table.of(text, widest)
            n_words.append(n)
            n_features.append(len(found))
            weight.append(int(gain[found].sum()))
        return {"doc_id": batch["doc_id"], "n_words": n_words, "n_features": n_features, "weight": weight}

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_features long, weight long"
    return map_batches(docs.select("doc_id", "text"), schema, run, lambda: FeatureBuckets(len(gain)))


def _counted(rows: DataFrame) -> DataFrame:
    """(block, digit, start): where the rows of each cell go, by prefix sums over digits, then over blocks."""
    cells = stored(rows.groupBy("block", "digit").agg(F.count("*").alias("n")), "cells")
    before = W.orderBy("digit").rowsBetween(W.unboundedPreceding, -1)  # over one row per digit value, 2^BITS at most
    digits = cells.groupBy("digit").agg(F.sum("n").alias("n"))
    first = digits.select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = W.partitionBy("digit").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    return cells.join(F.broadcast(first), "digit").select("block", "digit", start.alias("start"))


def radix_ranked(rows: DataFrame, keys: list[str], bits: int = BITS, block: int | None = None) -> DataFrame:
    """Add `place`, from 0 without gaps, in the ascending order of the long columns `keys`, most significant first.

    Rows equal in all keys take neighbouring places. Keys must not be null. An empty table stays empty. `rows` is read
    more than once, so it should be a stored table; columns named block, digit, start and place are replaced.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c not in ("block", "digit", "start", "place")]
    ends = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(keys) for k, f in (("a", F.min), ("b", F.max))]).first()
    if block is None:
        block = min(BLOCK, max(1024, -(-ends.n // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    blocks = max(1, -(-ends.n // block))
    # any first order will do, as long as every pass sees the same: the rows are stored with it
    now = rows.select(*names, F.monotonically_increasing_id().alias("place"))
    now = now.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
    for i in reversed(range(len(keys))) if ends.n else ():
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        if high - low < 1 << 63:
            unsigned, width = F.col(keys[i]) - F.lit(low), (high - low).bit_length()
        else:  # the difference does not fit: flip the sign bit, which keeps the order
            unsigned, width = F.col(keys[i]).bitwiseXOR(F.lit(-(1 << 63))), ((low ^ high) & ((1 << 64) - 1)).bit_length()
        for shift in range(0, width, bits):
            digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            now = stored(now.withColumn("digit", digit), "digits")
            order = W.partitionBy("block", "digit").orderBy("place")
            moved = now.join(_counted(now), ["block", "digit"]).withColumn("to", F.col("start") + F.row_number().over(order) - 1)
            now = moved.select(*names, F.col("to").alias("place"), F.floor(F.col("to") / block).alias("block"))
            now = stored(now, "passed")
    if ends.n and all(ends[f"a{i}"] == ends[f"b{i}"] for i in range(len(keys))):
        # nothing to sort by: one pass over a constant digit makes the places gapless
        now = stored(now.withColumn("digit", F.lit(0).cast("long")), "digits")
        order = W.partitionBy("block", "digit").orderBy("place")
        now = now.join(_counted(now), ["block", "digit"]).withColumn("place", F.col("start") + F.row_number().over(order) - 1)
    return now.select(*names, "place")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS, widest: int = WIDEST,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_features, weight, score and rank (null where not drawn).

    Of the documents with at least `least_words` words, floor(percent * their number / 100) are drawn by score, ties to the
    smaller doc_id, then to fewer features; rows equal in all three take neighbouring ranks, and a null doc_id comes last.
    Null and empty texts have no features and the weight 0. Repeated rows are drawn each for itself. An empty table, or an
    empty target, gives every bucket the gain of the smoothing alone. doc_id must be an integer column.
    """
    scored = weighted(docs, gains(docs, target, buckets, widest), widest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = stored(scored.withColumn("score", (F.col("weight") + gumbel).cast("long")), "scored")
    able = scored.where(F.col("n_words") >= least_words).withColumns(
        {"down": -F.col("score"), "known": F.col("doc_id").isNull().cast("long"), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    )
    ranked = radix_ranked(stored(able, "able"), ["down", "known", "id", "n_features"])
    take = percent * able.count() // 100
    place = F.when(F.col("place") < take, F.col("place") + 1)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.withColumn("rank", place).select(*columns).union(rest.select(*columns))
