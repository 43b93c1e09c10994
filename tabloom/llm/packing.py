"""Packing documents into sequences of at most CAPACITY tokens: best fit, then swap-based local search.

Every shard holds about SEQUENCES sequences and is packed by itself, so memory stays bounded and the waste is at most
about half a sequence per shard. Inside a shard, best-fit decreasing gives the start. The local search then takes the
emptiest bins and offers their documents to the fuller ones: a move, or an exchange of one for one, two for one or one
for two, is made when it fills the fuller bin further. Every different length and sum of two lengths that a bin can give
is tried. Each exchange shifts tokens from emptier to fuller bins and so raises the sum of squared fills; what stays behind
is packed again, and bins that end empty are gone. Rounds go on while bins empty, with ever fewer bins to empty at once.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.base import map_batches, stored

CAPACITY = 1024
SEQUENCES = 1024
END_ID = 2


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes, by their rule: visible Latin-1 characters
    stand for themselves, the other bytes follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from a text to its ids (a uint32 array) for a byte-level BPE file of the tokenizers library.

    Plain texts go through tiktoken with the file's own vocabulary and word pattern, which yields the same ids in a
    fifth of the time; texts that hold one of the file's special strings go through tokenizers itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own: list[Tokenizer] = []  # loaded when a text needs it
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = [t["content"] for t in model["added_tokens"]]
    chars = _bytes_of_chars()
    ranks = {bytes(chars[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            if not own:
                own.append(Tokenizer.from_file(path))
            return np.array(own[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row per piece. Only documents over `capacity` are cut; then all but
    the first piece are full."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        ids_of = encoder(tokenizer)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(batch["doc_id"], batch["text"]):
            ids = np.append(ids_of(text or ""), np.uint32(end_id)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            start = 0
            for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                for name, value in zip(out, (doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes()))):
                    out[name].append(value)
                start = end
        return out

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", run)


class _Pool:
    """Documents by length, with the largest length up to a bound found from a bit mask."""

    def __init__(self, capacity: int) -> None:
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, length: int, item: int) -> None:
        self.at[length].append(item)
        self.mask |= 1 << length

    def upto(self, length: int) -> int:
        """Largest length present that is at most `length`; 0 if there is none."""
        return (self.mask & ((1 << (length + 1)) - 1)).bit_length() - 1 if length > 0 and self.mask & ((1 << (length + 1)) - 1) else 0

    def take(self, length: int) -> int:
        item = self.at[length].pop()
        if not self.at[length]:
            self.mask &= ~(1 << length)
        return item


def best_fit(items: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: every item goes to the fullest bin with room."""
    bins: list[list[int]] = []
    room = _Pool(capacity)
    rooms: dict[int, int] = {}
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = room.mask >> n
        if fits:
            r = (fits & -fits).bit_length() - 1 + n
            b = room.take(r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        rooms[b] = r - n
        if r > n:
            room.put(r - n, b)
    return bins


def _gives(own: list[int], lengths: list[int]) -> dict[int, tuple[int, ...]]:
    """Every total that one or two documents of a bin have, each with documents that have it; one alone where both can."""
    by: dict[int, list[int]] = {}
    for i in own:
        by.setdefault(lengths[i], []).append(i)
    out: dict[int, tuple[int, ...]] = {}
    for n, ids in by.items():
        for m, others in by.items():
            if m < n:
                out.setdefault(n + m, (ids[0], others[0]))
        if len(ids) > 1:
            out.setdefault(2 * n, (ids[0], ids[1]))
    return out | {n: (ids[0],) for n, ids in by.items()}


def _exchange(own: list[int], lengths: list[int], room: int, pool: _Pool) -> bool:
    """Fill one bin further from the pool by its best move or exchange; False if none fits."""
    gain, plan = pool.upto(room), ((), None)
    if gain:
        plan = ((), (gain,))
    if gain < room:
        for n, give in _gives(own, lengths).items():
            one = pool.upto(n + room)
            if one - n > gain:
                gain, plan = one - n, (give, (one,))
            if len(give) == 1 and one and one < n + room:
                rest = n + room - one
                two = pool.upto(rest)
                if two == one and len(pool.at[one]) < 2:
                    two = pool.upto(one - 1)
                if two and one + two - n > gain:
                    gain, plan = one + two - n, (give, (one, two))
            if gain == room:
                break
    give, get = plan
    if gain <= 0 or get is None:
        return False
    for n in get:
        own.append(pool.take(n))
    for i in give:
        own.remove(i)
        pool.put(lengths[i], i)
    return True


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers. No item is longer than `capacity`."""
    full = [[i] for i, n in enumerate(lengths) if n == capacity]
    bins = best_fit([i for i, n in enumerate(lengths) if n < capacity], lengths, capacity)
    fill = lambda b: sum(lengths[i] for i in b)
    share = 2
    while True:
        full += [b for b in bins if fill(b) == capacity]
        bins = sorted((b for b in bins if fill(b) < capacity), key=fill)
        if sum(map(fill, bins)) > capacity * (len(bins) - 1):
            break  # no fewer bins can hold them
        few = max(1, len(bins) >> share)
        emptiest, others = bins[:few], [list(b) for b in bins[few:]]
        pool = _Pool(capacity)
        for b in emptiest:
            for i in b:
                pool.put(lengths[i], i)
        for b in reversed(others):
            room = capacity - fill(b)
            while room and _exchange(b, lengths, room, pool):
                room = capacity - fill(b)
        left = best_fit([i for items in pool.at for i in items], lengths, capacity)
        if len(left) <= few:
            bins = others + left
        if len(left) >= few:  # none emptied: try fewer at once, down to the emptiest alone
            if few == 1:
                break
            share += 1
    return full + bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, sequences: int = SEQUENCES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed each for itself, spread over the shards by a
    stored row number. An empty table gives an empty result.
    """
    cut = stored(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, -(-total // (capacity * sequences)))
    rows = cut.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        shard = table.column("shard")[0].as_py()
        lengths = table.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for number, own in enumerate(packed(lengths, capacity)):
            at = 0
            for i in own:
                sequence[i], offset[i] = (shard << 32) + number, at
                at += lengths[i]
        out = table.drop_columns(["row", "shard"])
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.groupBy("shard").applyInArrow(run, schema)
