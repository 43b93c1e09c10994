"""Phrase collocation mining by best-first branch and bound.

1. One pass over the texts stores them as chunks of word hashes (of language and word), with the chunk's word counts. Every
   later pass reads arrays only.
2. Words and word pairs are counted. A pair can only be frequent if both words are; a bitmap of fixed size marks the
   frequent words, so rare ones leave before the shuffle.
3. The frontier holds the frequent phrases whose extensions are not counted yet. With l the count of a prefix' first
   word and c that of the prefix, no extension scores above 2000000 * c / (l + c): its count is at most c, and the
   rest after the first word occurs at least as often as the whole. This bound is admissible and falls as counts do.
4. A round expands the best of the frontier: three- and four-word phrases are counted that begin with an expanded prefix, and,
   to settle who survives, those that end with a candidate. Bitmaps of fixed size choose them inside the tasks; a false
   mark only counts a phrase too many, exactly.
5. A language is settled when its TOP-th surviving score is above every bound left in its frontier. Until then the
   lowest score that still matters is its threshold; ties at the threshold are expanded too. A language with
   fewer survivors than TOP ends with an empty frontier.

A candidate is dropped for a longer phrase only if it is dropped for one of one word more, as counts do not rise with
length. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.base import small_batches, stored
from tabloom.llm.shingles import mix

#: Phrases have 2 to LONGEST words and at least LEAST occurrences; TOP are returned per language.
LONGEST = 4
LEAST = 30
TOP = 2000
#: A candidate is dropped within a longer phrase of at least this percentage of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: Candidates per language that a round of unknown threshold expands, as a multiple of TOP, and steps of that choice.
FIRST = 3
STEPS = 4096
#: Words of a chunk at which it is closed, the chunks a task reads at once, and the bits of a bitmap.
CHUNK, AT_ONCE = 1 << 16, 16
#: Passes in which pairs are counted, so that a task's table of different pairs stays small.
SHARES = 4
MARKS = 1 << 24

_K = np.uint64(0x9E3779B97F4A7C15)
#: Separators become line ends, tabs spaces, and A-Z lower case; bytes from 0x80 on never stand for ASCII.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256)
)
_END, _SKIP = 0, 1  # hashes kept for the end of a piece and for nothing between two spaces


def word_hash(word: bytes) -> int:
    value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)
    return value if value not in (_END, _SKIP) else 2


class _Words:
    """Hash of each word of each language, and back; emptied between chunks once large."""

    LIMIT = 50_000

    def __init__(self) -> None:
        self.of_lang: dict[str, _Hashes] = {}
        self.back: dict[int, tuple[str, bytes]] = {}

    def of(self, lang: str, text: str) -> np.ndarray:
        """Word hashes with _END between pieces and at the end."""
        known = self.of_lang.get(lang)
        if known is None:
            known = self.of_lang[lang] = _Hashes(lang, self.back)
        parts = text.encode("utf-8", "replace").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        return np.append(ids[ids != _SKIP], _END)


class _Hashes(dict):
    def __init__(self, lang: str, back: dict[int, tuple[str, bytes]]) -> None:
        super().__init__({b"\n": _END, b"": _SKIP})
        self.lang, self.seed, self.back = lang, lang.encode("utf-8", "replace") + b"\n", back

    def __missing__(self, word: bytes) -> int:
        value = self[word] = word_hash(self.seed + word)
        self.back[value] = (self.lang, word)
        return value


def encoded(docs: DataFrame) -> DataFrame:
    """Chunks (at, and id, lang, word and n of the chunk's vocabulary); a document is never cut. Null languages are `und`.

    `at` has the place in the vocabulary of each word, and of the piece ends, whose id is _END.
    """
    schema = "at array<int>, id array<long>, lang array<string>, word array<string>, n array<long>"

    def one(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, size = _Words(), [], 0

        def closed() -> pa.RecordBatch:
            known, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            names = [words.back.get(i, ("", b"")) for i in known.tolist()]
            columns = [pa.array(known), pa.array([x for x, _ in names], pa.string()), pa.array([w.decode("utf-8", "replace") for _, w in names], pa.string()), pa.array(n)]
            return pa.RecordBatch.from_arrays([one(pa.array(at.astype(np.int32))), *map(one, columns)], names=["at", "id", "lang", "word", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    if text:
                        parts.append(words.of("und" if lang is None else lang, text))
                        size += len(parts[-1])
                    if size >= CHUNK:
                        yield closed()
                        parts, size = [], 0
                        if len(words.back) > words.LIMIT:
                            words = _Words()
        if parts:
            yield closed()

    return docs.select("lang", "text").mapInArrow(run, schema)


def _slots(columns: list[np.ndarray]) -> np.ndarray:
    """Place in a bitmap of each phrase given word by word."""
    acc = np.full(len(columns[0]), np.uint64(len(columns)))
    for c in columns:
        acc = mix((acc + c.view(np.uint64)) * _K)
    return (acc >> np.uint64(20)).astype(np.int64) % MARKS


def _marks(phrases: DataFrame, words: int) -> np.ndarray:
    """Bitmap (MARKS bits as bytes) of phrases (w1, w2...): its size does not depend on their number."""
    names = [f"w{k}" for k in range(1, words + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS, bool)
        for batch in batches:
            bits[_slots([batch.column(n).to_numpy(zero_copy_only=False) for n in names])] = True
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "bits"])

    parts = phrases.select(*names).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = parts.toArrow()  # at most MARKS / 64 rows
    packed = np.zeros(MARKS // 64, np.int64)
    packed[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return packed.view(np.uint8)


def _counted(
    chunks: DataFrame, words: int, known: np.ndarray, chosen: list[tuple[int, int, np.ndarray]] | None = None, share: int | None = None
) -> DataFrame:
    """(w1...wn, a) of phrases of `words` words that may be frequent, each at least LEAST times. Stored.

    All words must be marked in `known`, and with `chosen`, a list of (start, length, bitmap), some part must be in its bitmap.
    With `share`, the first word's hash must fall into that one of SHARES.
    """
    names = [f"w{k}" for k in range(1, words + 1)]
    sent = chunks.sparkSession.sparkContext.broadcast([known, *[m for _, _, m in chosen or ()]])  # MARKS / 8 bytes each
    parts = [(start, size) for start, size, _ in chosen or ()]

    def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("id").slice(k, 1).flatten().to_numpy(zero_copy_only=False)[batch.column("at").slice(k, 1).flatten().to_numpy(zero_copy_only=False)]
                if len(ids) < words:
                    continue
                good = (ids != _END) & marked(sent.value[0], _slots([ids]))
                fits = np.ones(len(ids) - words + 1, bool)
                for k in range(words):
                    fits &= good[k : len(ids) - words + 1 + k]
                if share is not None:
                    fits &= ids[: len(fits)] % SHARES == share
                at = np.flatnonzero(fits)
                if parts:
                    wanted = np.zeros(len(at), bool)
                    for (start, size), bits in zip(parts, sent.value[1:]):
                        wanted |= marked(bits, _slots([ids[at + k] for k in range(start, start + size)]))
                    at = at[wanted]
                if not len(at):
                    continue
                columns = [ids[at + k] for k in range(words)]
                order = np.lexsort(columns[::-1])
                columns = [c[order] for c in columns]
                new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                yield pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in columns], pa.array(n)], names=[*names, "a"])

    counts = chunks.select("at", "id").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", a long")
    counts = counts.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)
    with small_batches(chunks.sparkSession, AT_ONCE):
        return stored(counts, "counts")


def _pairs(chunks: DataFrame, known: np.ndarray) -> DataFrame:
    return reduce(DataFrame.union, [_counted(chunks, 2, known, share=k) for k in range(SHARES)])


def _score(a: str | Column, l: str | Column, r: str | Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)) in exact decimal arithmetic; null if a part is."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    top = F.lit(SCALE).cast("decimal(7,0)") * c(a).cast("decimal(19,0)")
    return F.call_function("div", top, c(l).cast("decimal(19,0)") + c(r).cast("decimal(19,0)")).cast("long")


def _with(df: DataFrame, counts: DataFrame, words: list[str], name: str) -> DataFrame:
    """Add the count of the phrase made of columns `words`; null if it is not in `counts`."""
    right = counts.select(*[F.col(f"w{k}").alias(f"_w{k}") for k in range(1, len(words) + 1)], F.col("a").alias(name))
    on = F.lit(True)
    for k, w in enumerate(words, 1):
        on = on & (F.col(w) == F.col(f"_w{k}"))
    return df.join(right, on, "left").drop(*[f"_w{k}" for k in range(1, len(words) + 1)])


def _scored(level: DataFrame, words: int, counts: dict[int, DataFrame]) -> DataFrame:
    """Add lang, f1 (count of the first word), the lowest-scoring known cut (score, l, r) and `whole`: all cuts are known."""
    names = [f"w{k}" for k in range(1, words + 1)]
    out = level.join(counts[1].select("w1", "lang", F.col("a").alias("f1")), "w1")
    cuts, whole = [], F.lit(True)
    for k in range(1, words):
        out = _with(out, counts[k], names[:k], f"l{k}") if k > 1 else out.withColumn("l1", F.col("f1"))
        out = _with(out, counts[words - k], names[k:], f"r{k}")
        # a struct sorts by score, then by the number of the cut
        cuts.append(F.when(F.col(f"l{k}").isNotNull() & F.col(f"r{k}").isNotNull(), F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
        whole = whole & cuts[-1].isNotNull()
    cut = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    out = out.withColumns({"cut": cut, "whole": whole})
    return out.select("lang", *names, "a", "f1", "cut.score", "cut.l", "cut.r", "whole")


def _bounded(level: DataFrame) -> DataFrame:
    return level.withColumn("bound", _score("a", "f1", "a"))


def _within(level: DataFrame, plan: DataFrame, value: str) -> DataFrame:
    """Phrases whose `value` lies in the round's interval of their language."""
    return level.join(plan, "lang").where((F.col(value) >= F.col("low")) & (F.col(value) < F.col("high")))


def _next_low(pairs: DataFrame, plan: DataFrame, target: int) -> DataFrame:
    """(lang, high, low, done): the next interval below the last one, down to the best `target` pairs or to the end.

    Scores are counted in STEPS equal steps, so a language is a few numbers however many pairs it has.
    """
    step = SCALE // 2 // STEPS
    counts = pairs.groupBy("lang", F.floor(F.col("score") / step).alias("step")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("step")))
    low = counts.withColumn("upto", upto).groupBy("lang").agg(F.max(F.when(F.col("upto") >= target, F.col("step") * step)).alias("to"))
    low = plan.join(low, "lang", "left").withColumn("to", F.least(F.coalesce("to", F.lit(0)), F.col("low")))
    return low.select("lang", F.col("low").alias("high"), F.when(F.col("done"), F.col("low")).otherwise(F.col("to")).alias("low"), "done")


def _survivors(level: DataFrame, longer: DataFrame | None, words: int, plan: DataFrame) -> DataFrame:
    """Candidates at or above their language's threshold that no longer phrase covers."""
    names = [f"w{k}" for k in range(1, words + 1)]
    out = level.where("whole").join(plan, "lang").where(F.col("score") >= F.col("low"))
    if longer is not None:
        for shift in (0, 1):
            ends = longer.groupBy(*[F.col(f"w{k + shift}").alias(f"w{k}") for k in range(1, words + 1)]).agg(F.max("a").alias("a"))
            out = _with(out, ends, names, f"over{shift}")
        over = F.greatest(F.coalesce("over0", F.lit(0)), F.coalesce("over1", F.lit(0)))
        out = out.where(100 * over < COVERED * F.col("a"))
    padded = [F.col(f"w{k}") if k <= words else F.lit(None).cast("long").alias(f"w{k}") for k in range(1, LONGEST + 1)]
    return out.select("lang", *padded, "a", "l", "r", "score", "low")


def _joined(a: DataFrame | None, b: DataFrame) -> DataFrame:
    """Both tables of counts; a phrase counted twice has equal counts."""
    return b if a is None else a.union(b).distinct()


def mined(docs: DataFrame) -> DataFrame:
    """The first TOP surviving phrases of every language of `docs` (lang, text): lang, rank, phrase, a, l, r, n, score.

    Null texts are empty; a null language is `und`. Repeated rows count as often as they occur. Ties are ordered by a, then
    by phrase. Languages without candidates, and empty tables, give no rows.
    """
    with small_batches(docs.sparkSession):
        chunks = stored(encoded(docs), "chunks")
    v = F.col("v")
    words = chunks.select(F.explode(F.arrays_zip("id", "lang", "n")).alias("v")).where(v["id"] != _END).groupBy(v["id"].alias("w1"), v["lang"].alias("lang"))
    words = stored(words.agg(F.sum(v["n"]).alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.where(F.col("a") >= LEAST)
    known = _marks(frequent, 1)
    counts: dict[int, DataFrame | None] = {1: frequent, 2: _pairs(chunks, known), 3: None, 4: None}
    pairs = stored(_bounded(_scored(counts[2], 2, counts)), "scored")
    start = F.lit(SCALE).cast("long")  # above every score
    plan = stored(pairs.select("lang").distinct().select("lang", start.alias("low"), F.lit(False).alias("done")), "plan")
    target = FIRST * TOP
    while True:
        plan = stored(_next_low(pairs, plan, target), "plan")
        target *= 4
        chosen = [(0, 2, _marks(_within(pairs, plan, "bound"), 2)), (1, 2, _marks(_within(pairs, plan, "score"), 2))]
        counts[3] = stored(_joined(counts[3], _counted(chunks, 3, known, chosen)), "triples")
        triples = stored(_bounded(_scored(counts[3], 3, counts)), "scored")
        chosen = [(0, 3, _marks(_within(triples, plan, "bound"), 3)), (1, 3, _marks(_within(triples, plan, "score"), 3))]
        counts[4] = stored(_joined(counts[4], _counted(chunks, 4, known, chosen)), "fours")
        fours = stored(_scored(counts[4], 4, counts), "scored")
        # the last three words of a four-word candidate may be an unexpanded phrase: count it by itself
        open_ = fours.where("not whole").join(plan, "lang").where(F.col("score") >= F.col("low"))
        wanted = open_.select(*[F.col(f"w{k + 1}").alias(f"w{k}") for k in (1, 2, 3)])
        if not wanted.isEmpty():
            counts[3] = stored(_joined(counts[3], _counted(chunks, 3, known, [(0, 3, _marks(wanted, 3))])), "triples")
            triples = stored(_bounded(_scored(counts[3], 3, counts)), "scored")
            fours = stored(_scored(counts[4], 4, counts), "scored")
        found = _survivors(pairs, counts[3], 2, plan).union(_survivors(triples, counts[4], 3, plan)).union(_survivors(fours, None, 4, plan))
        found = stored(found, "survivors")
        enough = found.groupBy("lang").agg(F.count("*").alias("found"))
        settled = (F.coalesce("found", F.lit(0)) >= TOP) | (F.col("low") <= 0)
        plan = stored(plan.join(enough, "lang", "left").select("lang", "low", settled.alias("done")), "plan")
        if plan.where("not done").isEmpty():
            break
    best = F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    top = stored(found.withColumn("best", best).where(F.col("best") <= TOP), "top")
    shown = top.select(F.explode(F.array(*[f"w{k}" for k in range(1, LONGEST + 1)])).alias("w1")).where("w1 is not null").distinct()
    names = chunks.select(F.explode(F.arrays_zip("id", "word")).alias("v")).select(v["id"].alias("w1"), v["word"].alias("word"))
    names = stored(names.join(shown, "w1").groupBy("w1").agg(F.min("word").alias("word")), "names")
    for k in range(1, LONGEST + 1):
        top = top.join(names.select(F.col("w1").alias("_w"), F.col("word").alias(f"s{k}")), F.col(f"w{k}") == F.col("_w"), "left").drop("_w")
    top = top.withColumn("phrase", F.concat_ws(" ", *[f"s{k}" for k in range(1, LONGEST + 1)]))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = top.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= TOP)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
