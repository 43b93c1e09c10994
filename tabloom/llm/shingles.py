"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WIDTH = 5
_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word seen so far, in a table of bounded size."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() cuts at exactly the six ASCII spaces."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(width, n)
    acc = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        acc = mix((acc + hashes[k : n - take + 1 + k]) * _K)
    return acc


def shingle_set(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    return np.unique(runs(hashes.of(words_of(text)), width))


_WORD = ~np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: A number per place in a word, up to a place, and byte.
_PLACES = 64
_BYTES = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _K)


def hashed_words(text: str | None) -> np.ndarray:
    """Hash of each lower-cased (A-Z) word in order: a sum of one mixed number per place and byte, for all words at once."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower() if text else b"", np.uint8)
    at = np.flatnonzero(_WORD[raw])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    lengths = np.append(starts[1:], len(at)) - starts
    cell = (np.arange(len(at)) - np.repeat(starts, lengths)) * 256 + raw[at]
    if lengths.max() <= _PLACES:
        terms = _BYTES[cell]
    else:
        terms = mix((cell + 1).astype(np.uint64) * _K)
    return mix(np.add.reduceat(terms, starts))


def text_shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The shingle set without a table of words: for corpora whose words rarely come again within a task."""
    return np.unique(runs(hashed_words(text), width))
