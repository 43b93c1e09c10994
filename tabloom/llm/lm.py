"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting. One pass over the training texts gives sorted arrays of distinct n-gram hashes and their counts per task, cut
into buckets by their leading bits, so a task sends one small array per bucket instead of one row per n-gram. A bucket
merges its arrays into exact counts. An n-gram of count c has level 1 + floor(log_BASE c) and enters the filter once for
each level up to its own; every bucket is a segment of the filter, as large as its entries need.

Scoring. Probing levels upwards until one is missing reads the quantised count back; one pass does so for all texts and
stores the levels. A bigram's probability mixes its
quantised relative frequency with the unigram's; the weight depends on the level of the history and is the best of a grid
by leave-one-out likelihood over all training texts. The end of a text is a token and the history of the next start.

The filter holds every n-gram at every size. Up to FILTER_BYTES it is broadcast; a larger one stays a table of segments,
and each chunk of texts sends one array of its different n-grams to every bucket and gets their levels back, so both ways
yield equal scores. Exact unigram counts for the base score are broadcast for at most HEAD tokens, the most frequent; all
others are looked up by a shuffle join.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.base import forget, small_batches, stored
from tabloom.llm.shingles import WordHashes, mix

HELD_OUT_OF = 10
BASE = 1.5
LEVELS = 64
BITS, PROBES = 10, 4
#: Largest filter to broadcast, and bytes of text that look up a larger one together.
FILTER_BYTES, CHUNK_BYTES = 128 << 20, 4 << 20
HEAD = 1 << 20
#: Tokens per bucket, and n-grams a task holds before it sends them on.
BUCKET_TOKENS, HELD = 1_000_000, 600_000
GRID = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
_K = np.uint64(0x9E3779B97F4A7C15)
_EDGES = BASE ** np.arange(1, LEVELS)
#: Middle of the counts that share a level.
_LOW = np.ceil(BASE ** np.arange(LEVELS) - 1e-9)
MEAN = np.concatenate([[0.0], np.maximum((_LOW[:-1] + np.maximum(_LOW[1:] - 1, _LOW[:-1])) / 2, 1), [_LOW[-1]]])


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 0 for none, 1 for one."""
    return np.where(counts > 0, np.searchsorted(_EDGES, counts + 1e-9, side="right") + 1, 0)


def bigrams(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * _K + mix(after + np.uint64(2)))


def _parts(hashes: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (leading bits) and the 40 bits after it."""
    return hashes >> np.uint64(64 - shift), (hashes << np.uint64(shift)) >> np.uint64(24)


def _word_and_mask(bucket: np.ndarray, key: np.ndarray, level: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of its segment (`size` words) that holds an entry, and the entry's bits in it."""
    x = mix(((bucket << np.uint64(40)) | key) + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    word = ((x >> np.uint64(32)) * size) >> np.uint64(32)
    mask = np.uint64(1) << (x & np.uint64(63))
    for k in range(1, PROBES):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return word, mask


def _packed(keys: np.ndarray) -> bytes:
    """40-bit keys in five bytes each."""
    return (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (keys >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _probe(table: np.ndarray, bucket: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Quantised counts by repeated membership probes in the segments that begin at `start`."""
    out, live = np.zeros(len(key), np.uint8), np.arange(len(key))
    for level in range(1, LEVELS):
        word, mask = _word_and_mask(bucket, key, level, size)
        found = (table[start + word] & mask) == mask
        if not found.any():
            break
        bucket, key, start, size, live = bucket[found], key[found], start[found], size[found], live[found]
        out[live] = level
    return out


class Filter:
    """The assembled filter: a Bloom filter whose probes for one entry fall into one 64-bit word."""

    CHUNK = 1 << 15

    def __init__(self, segments: list[tuple[int, bytes]], shift: int) -> None:
        self.shift = shift
        self.start = np.zeros(1 << shift, np.uint64)
        self.size = np.ones(1 << shift, np.uint64)
        at, parts = 1, [bytes(8)]
        for bucket, data in segments:
            if data:
                self.start[bucket], self.size[bucket] = at, len(data) // 8
                parts.append(data)
                at += len(data) // 8
        self.data = b"".join(parts)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Quantised counts by repeated membership probes."""
        table = np.frombuffer(self.data, np.uint64)
        out = np.zeros(len(hashes), np.uint8)
        for first in range(0, len(hashes), self.CHUNK):
            bucket, key = _parts(hashes[first : first + self.CHUNK], self.shift)
            out[first : first + len(key)] = _probe(table, bucket, key, self.start[bucket], self.size[bucket])
        return out


class Answers:
    """Quantised counts that were looked up for one chunk of texts: buckets, keys and levels."""

    def __init__(self, parts: list[tuple[int, bytes, bytes]], shift: int) -> None:
        self.shift = shift
        whole = [np.uint64(bucket << 40) | _unpacked(keys) for bucket, keys, _ in parts]
        self.known = np.concatenate(whole) if whole else np.zeros(0, np.uint64)
        self.level = np.frombuffer(b"".join(levels for _, _, levels in parts), np.uint8)
        order = np.argsort(self.known)
        self.known, self.level = self.known[order], self.level[order]

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.uint8)
        bucket, key = _parts(hashes, self.shift)
        whole = bucket << np.uint64(40) | key
        at = np.minimum(np.searchsorted(self.known, whole), len(self.known) - 1)
        return np.where(self.known[at] == whole, self.level[at], 0).astype(np.uint8)


def _segment(bucket: int, keys: np.ndarray, counts: np.ndarray, cutoff: int = 1) -> bytes:
    levels = np.where(counts >= cutoff, level_of(counts), 0)
    total = int(levels.sum())
    if not total:
        return b""
    words = np.zeros(-(-total * BITS // 64), np.uint64)
    for level in range(1, int(levels.max()) + 1):
        own = keys[levels >= level]
        word, mask = _word_and_mask(np.full(len(own), bucket, np.uint64), own, level, np.uint64(len(words)))
        order = np.argsort(word)
        word, mask = word[order], mask[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] |= np.bitwise_or.reduceat(mask, first)
    return words.tobytes()


#: Stands for END among the words of joined texts; this byte occurs in no UTF-8 text.
_MARK = b"\xff"
END = WordHashes()[_MARK]


def _split(texts: list) -> list[bytes]:
    """Lower-cased words of all texts behind one another, each text closed by the mark."""
    return (b" \xff ".join([t.encode("utf-8", "replace") if t else b"" for t in texts]) + b" \xff").lower().split() if texts else []


def _tokens(texts: list, hashes: WordHashes) -> np.ndarray:
    """Token hashes of all texts behind one another, each text closed by END."""
    return hashes.of(_split(texts))


def _histories(tokens: np.ndarray) -> np.ndarray:
    """The token before each; END before the first of a text, as texts follow one another closed by END."""
    return np.concatenate([[END], tokens[:-1]]).astype(np.uint64) if len(tokens) else tokens


def _merge(a: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new, times = np.unique(hashes, return_counts=True)
    keys, inverse = np.unique(np.concatenate([a[0], new]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([a[1], times])).astype(np.int64) if len(keys) else a[1]


def partial_counts(texts: DataFrame, shift: int) -> DataFrame:
    """bucket, kind (1 words, 2 bigrams), keys and counts as bytes: what each task has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        seen, waiting, size = {1: none, 2: none}, {1: [], 2: []}, 0

        def fold() -> None:
            for kind in seen:
                if waiting[kind]:
                    seen[kind] = _merge(seen[kind], np.concatenate(waiting[kind]))
                    waiting[kind] = []

        def send() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in seen.items():
                seen[kind] = none
                bucket = (keys >> np.uint64(64 - shift)).astype(np.int64)
                ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(keys))
                start, rows = 0, ([], [], [])
                for end in ends if len(keys) else []:
                    own = keys[start:end]
                    if kind == 2:
                        data = _packed(_parts(own, shift)[1])
                    else:
                        data = own.astype("<u8").tobytes()
                    for column, value in zip(rows, (int(bucket[start]), data, counts[start:end].astype("<u4" if kind == 2 else "<u8").tobytes())):
                        column.append(value)
                    start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int32()), pa.array([kind] * len(rows[0]), pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
                    names=["bucket", "kind", "keys", "counts"],
                )

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                tokens = _tokens(batch.column(0).slice(k, 512).to_pylist(), hashes)
                waiting[1].append(tokens)
                waiting[2].append(bigrams(_histories(tokens), tokens))
                size += len(tokens)
                if size > HELD // 4:
                    fold()
                    size = 0
                    if len(seen[2][0]) > HELD:
                        yield from send()
        fold()
        yield from send()

    return texts.mapInArrow(run, "bucket int, kind int, keys binary, counts binary")


def merged_counts(partial: DataFrame, shift: int, common: int) -> DataFrame:
    """Per bucket: its filter segment and the number of entries in it.

    Words seen `common` times and more stay out of the filter, as their exact counts are broadcast.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = {1: [], 2: []}, {1: [], 2: []}
        for kind, k, c in zip(*[table.column(n).to_pylist() for n in ("kind", "keys", "counts")]):
            if kind == 2:
                keys[2].append(_unpacked(k))
                counts[2].append(np.frombuffer(c, "<u4").astype(np.int64))
            else:
                keys[1].append(np.frombuffer(k, "<u8"))
                counts[1].append(np.frombuffer(c, "<u8").astype(np.int64))
        exact = {}
        for kind in (1, 2):
            if keys[kind]:
                k, inverse = np.unique(np.concatenate(keys[kind]), return_inverse=True)
                exact[kind] = k, np.bincount(inverse, np.concatenate(counts[kind])).astype(np.int64)
            else:
                exact[kind] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        words, pairs = exact[1], exact[2]
        rare = words[1] < common
        all_keys = np.concatenate([_parts(words[0][rare], shift)[1], pairs[0]])
        all_counts = np.concatenate([words[1][rare], pairs[1]])
        return pa.table({
            "bucket": pa.array([bucket], pa.int32()),
            "segment": pa.array([_segment(bucket, all_keys, all_counts)], pa.binary()),
            "entries": pa.array([int(level_of(all_counts).sum())], pa.int64()),
        })

    schema = "bucket int, segment binary, entries long"
    return stored(partial.groupBy("bucket").applyInArrow(run, schema), "segments")


def _word_counts(partial: DataFrame) -> DataFrame:
    """Exact (word hash, count) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns = [pa.array(np.frombuffer(x, "<i8")) for x in (words, times)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "c"])

    rows = partial.where("kind = 1").select("keys", "counts").mapInArrow(run, "word long, c long")
    return stored(rows.groupBy("word").agg(F.sum("c").alias("c")), "words")


class Model:
    """What scoring needs on every worker; without a filter if that stays a table."""

    def __init__(self, bloom: Filter | Answers | None, shift: int, head: tuple[np.ndarray, np.ndarray], n: int, v: int) -> None:
        self.bloom, self.shift, self.n, self.floor = bloom, shift, n, n + 0.1 * (v + 1)
        self.head = head

    def over(self, bloom: Answers) -> Model:
        out = copy.copy(self)
        out.bloom = bloom
        return out

    def counted(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of words; -1 for those not among the head."""
        keys, counts = self.head
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return np.where(keys[at] == h, counts[at], -1) if len(keys) else np.full(len(h), -1)


class _Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        at = self[word] = len(self)
        return at


class Words:
    """Hash, exact count (-1: not among the head), level and base term of each word seen so far, in tables of bounded
    size. END has place 0."""

    LIMIT = 120_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.place = _Places({_MARK: 0})
        self.place.fresh = []
        self.used = 0
        self.hash, self.count, self.level = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.uint8)
        self._add(np.array([END], np.uint64))

    def _add(self, h: np.ndarray) -> None:
        count = self.model.counted(h)
        end = self.used + len(h)
        if end > len(self.hash):
            room = max(end, 2 * len(self.hash))
            self.hash, self.count, self.level = (np.resize(x, room) for x in (self.hash, self.count, self.level))
        level = np.where(count > 0, level_of(np.maximum(count, 0)), self.model.bloom.levels(h))
        self.hash[self.used : end], self.count[self.used : end], self.level[self.used : end] = h, count, level
        self.used = end

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of all texts and where each text begins."""
        if self.used > self.LIMIT:
            self._reset()
        words = _split(texts)
        tokens = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if self.place.fresh:
            self._add(WordHashes().of(self.place.fresh))
            self.place.fresh = []
        return tokens, np.concatenate([[0], np.flatnonzero(tokens == 0)[:-1] + 1]) if len(tokens) else tokens


def _probed(tokens: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: level of the bigram, level of the history, and the unigram's count (exact where it is broadcast)."""
    before = np.concatenate([[0], tokens[:-1]])
    pair = words.model.bloom.levels(bigrams(words.hash[before], words.hash[tokens]))
    known = words.count[tokens]
    return pair.astype(np.uint8), words.level[before], np.where(known >= 0, known, MEAN[words.level[tokens]])


def _estimates(pair: np.ndarray, history: np.ndarray, own: np.ndarray, less: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Relative frequency after the history, unigram probability, and level of the history; `less` occurrences are
    taken out of every count (leave-one-out)."""
    among = MEAN[history] - less
    share = np.minimum(np.maximum(MEAN[pair] - less, 0) / np.maximum(among, 1), 1.0)
    share[among <= 0] = 0
    return share, (np.maximum(own - less, 0) + 0.1) / floor, np.where(among > 0, history, 0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def _columns(batch: pa.RecordBatch, k: int, size: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The probed levels and counts of some rows, behind one another."""
    part = batch.slice(k, size)
    return tuple(np.frombuffer(b"".join(part.column(n).to_pylist()), t) for n, t in (("pair", np.uint8), ("history", np.uint8), ("own", np.float32)))


def _fit_weights(probed: DataFrame, floor: float) -> np.ndarray:
    """Weight of the bigram for each history level: the best of GRID by leave-one-out likelihood over all training texts."""
    names = [f"g{i}" for i in range(len(GRID))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((LEVELS + 1, len(GRID)))
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                share, single, level = _estimates(*_columns(batch, k, 64), 1, floor)
                for j, g in enumerate(GRID):
                    sums[:, j] += np.bincount(level, np.log(g * share + (1 - g) * single), LEVELS + 1)
        used = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(sums[used, j]) for j in range(len(GRID))]], names=["level", *names])

    rows = probed.where("not held_out").select("pair", "history", "own").mapInArrow(run, "level int, " + ", ".join(f"{n} double" for n in names))
    out = np.zeros(LEVELS + 1)
    for row in rows.groupBy("level").agg(*[F.sum(n).alias(n) for n in names]).collect():  # one row per level
        out[row["level"]] = GRID[int(np.argmax([row[n] for n in names]))] if row["level"] else 0
    return out


def fit(texts: DataFrame, filter_bytes: int = FILTER_BYTES, head: int = HEAD) -> tuple[object, DataFrame | None, DataFrame, int, int]:
    """The broadcast model, the segments of a filter too large for it, exact word counts, and the numbers of tokens and
    of different tokens."""
    sc = texts.sparkSession.sparkContext
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shift = max(5, int(chars // 6 // BUCKET_TOKENS).bit_length())
    with small_batches(texts.sparkSession):
        partial = stored(partial_counts(texts, shift), "partial")
    # words need their exact counts first; the filter of every cutoff follows from the same partial counts
    words = _word_counts(partial)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # powers of two bound how many words have at least a count
    rows = words.groupBy(F.length(F.bin("c")).alias("p")).count().collect()
    least, room = 1 << 62, head
    for row in sorted(rows, key=lambda r: -r["p"]):
        room -= row["count"]
        if room < 0:
            break
        least = 1 << (row["p"] - 1)
    segments = merged_counts(partial, shift, least)
    forget(partial)
    small = (segments.agg(F.sum("entries")).first()[0] or 0) * BITS <= 8 * filter_bytes
    top = words.where(F.col("c") >= least).toArrow()  # at most `head` rows
    keys = np.asarray(top.column("word")).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    bloom = None
    if small:
        parts = [(r["bucket"], bytes(r["segment"])) for r in segments.select("bucket", "segment").toLocalIterator()]  # at most filter_bytes
        bloom = Filter(parts, shift)
        del parts
        forget(segments)
    model = Model(bloom, shift, (keys[order], np.asarray(top.column("c")).astype(np.int64)[order]), total["n"], total["v"])
    return sc.broadcast(model), None if small else segments, words, total["n"], total["v"]


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """chunk, doc_id, text: texts that follow one another in a task, about `size` bytes in a chunk."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, upto = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            length = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = upto + np.cumsum(length) - length
            upto += int(length.sum())
            yield pa.RecordBatch.from_arrays([pa.array(first + starts // size), batch.column(0), batch.column(1)], names=["chunk", "doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_id {kind}, text string")


def _looked_up(chunks: DataFrame, segments: DataFrame, model: object, size: int) -> DataFrame:
    """chunk, bucket, keys and levels: what the filter's segments say to the different n-grams of every chunk."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shift = WordHashes(), model.value.shift

        def send(chunk: int, waiting: list[np.ndarray]) -> pa.RecordBatch:
            bucket, key = _parts(np.unique(np.concatenate(waiting)), shift)
            cuts = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(key))
            spans = list(zip([0, *cuts[:-1]], cuts))
            rows = [int(bucket[a]) for a, _ in spans], [_packed(key[a:b]) for a, b in spans]
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(spans), pa.int64()), pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], names=["chunk", "bucket", "keys"]
            )

        now, waiting, held = None, [], 0
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.diff(chunk)) + 1, len(chunk))
            for a, b in zip([0, *edges[:-1]], edges):
                for k in range(a, b, 512):
                    if waiting and (chunk[a] != now or held > size):
                        yield send(now, waiting)
                        waiting, held = [], 0
                    now = int(chunk[a])
                    tokens = _tokens(batch.column(1).slice(k, min(512, b - k)).to_pylist(), hashes)
                    words = np.unique(tokens)
                    waiting += [np.unique(bigrams(_histories(tokens), tokens)), words[model.value.counted(words) < 0]]
                    held += len(tokens)
        if waiting:
            yield send(now, waiting)

    def reply(asked: pa.Table, own: pa.Table) -> pa.Table:
        keys = asked.column("keys").to_pylist()
        table = np.frombuffer(own.column("segment")[0].as_py() if own.num_rows else b"", np.uint64)
        every = np.concatenate([_unpacked(k) for k in keys]) if keys else np.zeros(0, np.uint64)
        levels = np.zeros(len(every), np.uint8)
        for first in range(0, len(every) if len(table) else 0, Filter.CHUNK):
            key = every[first : first + Filter.CHUNK]
            bucket = np.full(len(key), asked.column("bucket")[0].as_py(), np.uint64)
            levels[first : first + len(key)] = _probe(table, bucket, key, np.zeros(len(key), np.uint64), np.full(len(key), len(table), np.uint64))
        ends = np.cumsum([len(k) // 5 for k in keys])
        parts = [levels[b - len(k) // 5 : b].tobytes() for k, b in zip(keys, ends)]
        return asked.select(["chunk", "bucket", "keys"]).append_column("levels", pa.array(parts, pa.binary()))

    asked = chunks.select("chunk", "text").mapInArrow(ask, "chunk long, bucket int, keys binary")
    both = asked.groupBy("bucket").cogroup(segments.select("bucket", "segment").groupBy("bucket"))
    return both.applyInArrow(reply, "chunk long, bucket int, keys binary, levels binary")


def score(docs: DataFrame, filter_bytes: int = FILTER_BYTES, head: int = HEAD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone. Repeated rows are trained on and scored each for itself. Without
    training texts all counts are 0 and both scores follow from the smoothing alone. An empty table gives an empty result.
    """
    model, segments, words, n, v = fit(docs.where(~held_out(F.col("doc_id"))).select("text"), filter_bytes, head)
    kind = dict(docs.dtypes)["doc_id"]
    floor = n + 0.1 * (v + 1)

    def levels(part: pa.RecordBatch, table: Words) -> pa.RecordBatch:
        tokens, starts = table.of(part.column(1).to_pylist())
        pair, history, own = _probed(tokens, table)
        own = own.astype(np.float32)
        count = table.count[tokens]
        ends = np.append(starts[1:], len(tokens))
        terms = np.where(table.count >= 0, np.log10((np.maximum(table.count, 0) + 0.1) / floor), 0.0)
        base = np.add.reduceat(terms[tokens], starts)
        known = np.add.reduceat((count > 0).astype(np.int64), starts)
        doc = np.repeat(np.arange(len(starts)), ends - starts)
        rare = np.flatnonzero(count < 0)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(starts)))]).astype(np.int32)
        cut = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in (pair, history, own)]
        rare_words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.hash[tokens[rare]].view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(ends - starts), pa.array(known), pa.array(base), rare_words, *cut],
            names=["doc_id", "n_tokens", "known", "base", "rare", "pair", "history", "own"],
        )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words(model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                yield levels(batch.slice(k, 128), table)

    def probe_chunk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = list(zip(*[answers.column(c).to_pylist() for c in ("bucket", "keys", "levels")]))
        table = Words(model.value.over(Answers(parts, model.value.shift)))
        rows = texts.select(["doc_id", "text"]).combine_chunks().to_batches()
        return pa.Table.from_batches([levels(r.slice(k, 128), table) for r in rows for k in range(0, r.num_rows, 128)])

    schema = f"doc_id {kind}, n_tokens long, known long, base double, rare array<long>, pair binary, history binary, own binary"
    if segments is None:
        rows = docs.select("doc_id", "text").mapInArrow(probe, schema)
    else:
        chunks = stored(_chunks(docs, chunk_bytes), "chunks")
        answers = _looked_up(chunks, segments, model, chunk_bytes)
        rows = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(probe_chunk, schema)
    with small_batches(docs.sparkSession):
        probed = stored(rows.withColumns({"row": F.monotonically_increasing_id(), "held_out": held_out(F.col("doc_id"))}), "probed")
    if segments is not None:
        forget(segments, chunks)
    weights = _fit_weights(probed, floor)

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                share, single, level = _estimates(*_columns(batch, k, 64), 0, floor)
                weight = weights[level]
                part = batch.slice(k, 64)
                starts = np.concatenate([[0], np.cumsum(part.column("n_tokens").to_numpy())[:-1]]).astype(np.int64)
                total = np.add.reduceat(np.log10(weight * share + (1 - weight) * single), starts)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("doc_id", "held_out", "n_tokens", "known", "base", "row")], pa.array(total)],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "row", "score"],
                )

    columns = ["doc_id", "held_out", "n_tokens", "known", "base", "row", "pair", "history", "own"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, row long, score double"
    scored = probed.select(columns).mapInArrow(mixed, schema)
    rare = probed.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0))
    term = F.col("times") * F.log10((c + F.lit(0.1)) / F.lit(floor))
    found = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(term).alias("rare_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )
