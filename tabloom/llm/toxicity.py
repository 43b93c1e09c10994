"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words weighs their common subsequences of ORDER characters, gaps included, by DECAY to the length they
span, and is normalized; so inserted or dropped characters weaken a match instead of ending it. The unit of the kernel is
a window of a sentence: each word, each run of very short words joined (letters set apart by spaces), and of words longer
than LONG overlapping windows, so that a text without spaces costs linear time. Units are lower-cased, stripped of
everything but letters and digits, and get a start and an end mark. A unit, called a word below, is described by its kernels with LANDMARKS
strings; whitening by the landmarks' own kernel matrix is the Nyström map, on which a linear machine with squared hinge
loss is trained. A sentence is as toxic as its worst word. As labels belong to documents, the worst sentence of a toxic
document is its positive example and the worst sentences of clean ones join the negatives, chosen anew in every round. A
document scores by its worst words and by how many lie on the toxic side, through a logistic curve.

Training reads at most SAMPLE labelled documents of each class, the first in a seeded order; scoring reads every text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.base import map_batches, stored

ORDER, DECAY = 3, 0.6
LANDMARKS = 28
#: How many of them are ordinary words, and how many are the clean words that a first machine takes for toxic ones.
COMMON, HARD = 2, 6
LANDMARK_LENGTH = 10
#: Longest word that is one unit, and the length and step of the windows of longer ones.
LONG, WINDOW, STEP = 48, 32, 16
#: Words of at most SHORT characters are joined where at least RUN of them stand in a row.
SHORT, RUN = 2, 3
#: Labelled documents of each class used for training.
SAMPLE = 800
#: Negative sentences of each clean training document.
NEGATIVES = 12
ROUNDS = 3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

_OTHER = re.compile(r"[\W_]+")
_ENDS = ".!?;:"


def plain(word: str) -> str:
    """The letters and digits of a word between a start and an end mark."""
    return "^" + _OTHER.sub("", word.lower()) + "$"


def _windows(word: str) -> list[str]:
    return [word] if len(word) <= LONG else [word[k : k + WINDOW] for k in range(0, len(word) - STEP, STEP)]


def units(text: str | None) -> list[str]:
    """What the kernel sees of a text, in the order of its sentences."""
    words = (text or "").split()
    size = np.fromiter(map(len, words), np.int64, len(words))
    short = size <= SHORT
    near = short[2:] & short[1:-1] & short[:-2]
    if not near.any() and not (size > LONG).any():
        return words
    out: list[str] = []
    run: list[str] = []
    for w in [*words, None]:
        if w is not None and len(w) <= SHORT:
            run.append(w)
            continue
        if len(run) >= RUN:
            # the joined run stands before its words, so that a stop mark at its end closes the sentence after both
            out += _windows("".join(run).rstrip(_ENDS) or run[0])
        out += run
        run = []
        if w is not None:
            out += _windows(w)
    return out


def _spread(width: int) -> np.ndarray:
    """DECAY ** (column - row + 1) above the diagonal: what a match at `row` still weighs at a later end `column`."""
    gap = np.arange(width + 1)[None, :] - np.arange(width)[:, None]
    return np.where(gap > 0, DECAY ** (gap + 1.0), 0.0).astype(np.float32)


def kernel(a: np.ndarray, masks: np.ndarray, pick) -> np.ndarray:
    """Subsequence kernels of equally long words with strings laid out in `masks`.

    `a` (n, length) holds symbols. `pick(column)` gives where the strings of each word have that symbol, as 0 and 1 in
    (n, m, width). Follows the usual recursion over prefixes, for all words and strings at once.
    """
    n, length = a.shape
    m, width = masks
    spread = _spread(width)
    parts = [np.zeros((n, m, width + 1), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros((n, m), np.float32)
    for x in range(length):
        same = pick(a[:, x])
        total += np.float32(DECAY * DECAY) * np.einsum("nmw,nmw->nm", same, parts[-1][:, :, :width])
        for i in range(ORDER - 2, -1, -1):
            source = same * parts[i - 1][:, :, :width] if i else same
            parts[i] *= np.float32(DECAY)
            parts[i] += (source.reshape(n * m, width) @ spread).reshape(n, m, width + 1)
    return total


class WordKernels:
    """Normalized kernels of words with the landmarks, and a value per word kept in tables of bounded size."""

    LIMIT = 600_000

    def __init__(self, landmarks: list[str], weights: np.ndarray | None = None) -> None:
        self.count, self.width = len(landmarks), max(map(len, landmarks))
        letters = sorted(set("".join(landmarks)))
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}
        self.masks = np.zeros((len(letters) + 1, self.count, self.width), np.float32)
        for k, mark in enumerate(landmarks):
            for j, c in enumerate(mark):
                self.masks[self.symbol[c], k, j] = 1
        self.norm = np.array([self.own([w])[0] for w in landmarks], np.float32)
        self.weights = weights
        self.value: dict[str, float] = {}
        self.by_form: dict[str, float] = {}

    @staticmethod
    def own(words: list[str]) -> np.ndarray:
        """Kernel of each of equally long words with itself."""
        c = np.frombuffer("".join(words).encode("utf-32-le"), np.int32).reshape(len(words), -1)
        return kernel(c, (1, c.shape[1]), lambda x: (c == x[:, None]).astype(np.float32)[:, None, :])[:, 0]

    def of(self, words: list[str]) -> np.ndarray:
        """Kernels of plain words with the landmarks, (n, landmarks)."""
        out = np.zeros((len(words), self.count), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        get = self.symbol.get
        for length, at in by_length.items():
            if length < ORDER:
                continue
            step = max(4, 256 if length <= 64 else 16_384 // length)
            for k in range(0, len(at), step):
                part = [words[i] for i in at[k : k + step]]
                c = np.array([[get(x, 0) for x in w] for w in part])
                cross = kernel(c, (self.count, self.width), lambda x: self.masks[x])
                out[at[k : k + step]] = cross / np.sqrt(np.maximum(self.own(part), 1e-30)[:, None] * self.norm)
        return out

    def margins(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Value of each raw word of each text under `weights`."""
        if len(self.value) > self.LIMIT:
            self.value, self.by_form = {}, {}
        value, known = self.value, self.by_form
        fresh = {w for words in texts for w in words if w not in value}
        if fresh:
            forms = {w: plain(w) for w in fresh}
            different = sorted({f for f in forms.values() if f not in known})
            known.update(zip(different, (self.of(different) @ self.weights).tolist()))
            value.update((w, known[f]) for w, f in forms.items())
        return [np.fromiter(map(value.__getitem__, words), np.float64, len(words)) for words in texts]


def sentence_starts(words: list[str]) -> np.ndarray:
    """Places where sentences begin: a word that closes one ends in a stop mark."""
    ends = [i + 1 for i, w in enumerate(words) if w[-1] in _ENDS]
    return np.array([0, *[e for e in ends if e < len(words)]], np.int64)


def described(values: np.ndarray) -> list[float]:
    """What a document's word margins say: the worst, the worst three, and how many lie on the toxic side."""
    top = np.sort(np.partition(values, -3)[-3:])[::-1] if len(values) > 3 else np.sort(values)[::-1]
    top = np.concatenate([top, np.full(3 - len(top), -1.0)])
    over = np.maximum(values + 0.5, 0).sum()
    return [top[0], top.mean(), np.log1p(over), np.log1p(over) / np.log1p(len(values) + 20)]


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def scores(self, texts: list[list[str]], kernels: WordKernels) -> np.ndarray:
        """Probability of each text of words; a text without words has the features of one that matches nothing."""
        if not texts:
            return np.zeros(0)
        x = np.array([[*described(v + self.bias), 1.0] for v in kernels.margins(texts)])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -40, 40)))


def _grams(word: str) -> set[str]:
    return {word[i : i + n] for n in range(4, 7) for i in range(len(word) - n + 1)}


def _around(word: str, part: str) -> set[str]:
    """Substrings of `word` that hold `part`, up to the length of a landmark."""
    at = word.find(part)
    ends = range(at + len(part), len(word) + 1)
    return {word[i:j] for i in range(at + 1) for j in ends if j - i <= LANDMARK_LENGTH} if at >= 0 else set()


def pick_landmarks(toxic: list[set[str]], clean: list[set[str]], count: int) -> list[str]:
    """Strings that stand out in toxic documents, each once, and some common clean words beside them."""
    t, c = Counter(), Counter()
    for words in toxic:
        t.update(set().union(*map(_grams, words)))
    ratio = len(toxic) / max(len(clean), 1)
    least = max(5, len(toxic) // 200)
    frequent = {g for g, n in t.items() if n >= least}
    of_word = {w: _grams(w) & frequent for w in set().union(*toxic, *clean)}
    for words in clean:
        c.update(set().union(*[of_word[w] for w in words]))
    strong = {g for g in frequent if t[g] - c[g] * ratio > 4 * (c[g] * ratio + 1) ** 0.5}
    del t
    of_word = {w: own for w, g in of_word.items() if (own := g & strong)}
    left = [{w for w in words if w in of_word} for words in toxic]
    told = [0] * len(left)
    chosen: list[str] = []
    for _ in range(count - COMMON - HARD):
        # documents explained least so far decide which string comes next
        now, weight = Counter(), Counter()
        for words, k in zip(left, told):
            for g in set().union(*[of_word[w] for w in words]):
                now[g] += 1
                weight[g] += 0.5**k
        usable = [g for g in now if now[g] >= least]
        if not usable:
            break
        best = max(usable, key=lambda g: (weight[g] / (1 + c[g] * ratio), len(g), g))
        # the longest string around it that is nearly as frequent
        near = Counter()
        for words in left:
            near.update(set().union(*[_around(w, best) for w in words]))
        best = max((g for g in near if near[g] >= 0.8 * near[best]), key=lambda g: (len(g), near[g], g))
        chosen.append(best)
        told = [k + any(best in w for w in words) for words, k in zip(left, told)]
        left = [{w for w in words if best not in w} for words in left]
    common = Counter()
    for words in clean:
        common.update(w for w in words if 4 <= len(w) <= LANDMARK_LENGTH)
    chosen += [w for w, _ in common.most_common(count) if w not in chosen][: count - HARD - len(chosen)]
    return [w[:LANDMARK_LENGTH] for w in chosen]


def _fit(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last weight is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(penalty + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def train(texts: list[str], labels: list[int], count: int = LANDMARKS, seed: int = 7) -> Model | None:
    """Fit on whole labelled documents; None if a class is missing."""
    split = [units(t) for t in texts]
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    known: dict[str, str] = {}
    forms = [[known.get(w) or known.setdefault(w, plain(w)) for w in words] for words in split]
    sets = [set(f) for f in forms]
    marks = pick_landmarks([s for s, v in zip(sets, y) if v], [s for s, v in zip(sets, y) if not v], count)
    if not marks:
        return None
    vocabulary = sorted(set().union(*sets))
    place = {w: i for i, w in enumerate(vocabulary)}
    at = [np.array([place[f] for f in words], np.int64) for words in forms]
    starts = [sentence_starts(words) if words else None for words in split]
    rng = np.random.default_rng(seed)
    clean = [k for k in range(len(y)) if not y[k] and len(at[k])]
    toxic = [k for k in range(len(y)) if y[k] and len(at[k])]

    def witnesses(k: int, value: np.ndarray, most: int) -> np.ndarray:
        """The best words of the document's best sentences."""
        v = value[at[k]]
        best = np.maximum.reduceat(v, starts[k])
        return np.unique([np.flatnonzero(v == top)[0] for top in np.sort(best)[::-1][:most]])

    usual = np.unique(np.concatenate([at[k][rng.permutation(len(at[k]))[:NEGATIVES]] for k in clean]))
    start = WordKernels(marks).of(vocabulary)[:, : suggested(marks, sets, y)]
    # before there is a machine, the word nearest to a landmark that toxic documents suggest
    value = start.max(1) if start.shape[1] else np.zeros(len(vocabulary))
    for again in range(2):
        kernels = WordKernels(marks)
        own = kernels.of(marks).astype(np.float64)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        whiten = vectors @ np.diag(np.maximum(values, 1e-2) ** -0.5) @ vectors.T
        z = kernels.of(vocabulary) @ whiten
        hard: list[np.ndarray] = []
        for turn in range(ROUNDS):
            positive = np.concatenate([at[k][witnesses(k, value, 1)] for k in toxic])
            hard += [at[k][witnesses(k, value, 1)] for k in clean]
            bent = kernels.of(_bent([vocabulary[i] for i in np.unique(positive)], rng)) @ whiten
            sets_ = [z[positive], bent, z[usual], z[np.concatenate(hard)]]
            sign = np.concatenate([np.full(len(x), 1.0 if i < 2 else -1.0) for i, x in enumerate(sets_)])
            w = _fit(np.vstack(sets_), sign, np.concatenate([np.full(len(x), 0.25 / len(x)) for x in sets_]))
            value = z @ w[:-1] + w[-1]
        if not again:
            times = Counter(i for k in clean for i in np.unique(at[k]) if value[i] > 0)
            marks = marks + [vocabulary[i][:LANDMARK_LENGTH] for i, _ in times.most_common(HARD)]
            marks = list(dict.fromkeys(marks))
    features = np.array([described(value[i]) for i in at])
    return Model(marks, (whiten @ w[:-1]).astype(np.float32), float(w[-1]), _curve(features, y))


def _bent(words: list[str], rng: np.random.Generator) -> list[str]:
    """Copies with one letter put in or doubled, so that the machine learns to bear gaps."""
    out = []
    for w in words:
        for fill in (w[1 + rng.integers(0, len(w) - 1)] if len(w) > 2 else "", chr(97 + rng.integers(0, 26))):
            at = 2 + rng.integers(0, max(1, len(w) - 2))
            out.append(w[:at] + fill + w[at:])
    return out


def suggested(marks: list[str], sets: list[set[str]], y: np.ndarray) -> int:
    """How many of the first landmarks occur relatively more often in toxic documents."""
    for k, mark in enumerate(marks):
        rate = [np.mean([any(mark in w for w in s) for s, v in zip(sets, y) if v == label] or [0]) for label in (0, 1)]
        if rate[1] <= 2 * rate[0]:
            return k
    return len(marks)


def _curve(features: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic curve over the features, with Platt's smoothed targets and a small penalty."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[features, np.ones(len(y))]
    penalty = ridge * np.diag([1.0] * features.shape[1] + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - target) + penalty @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


_KEPT: dict[bytes, WordKernels] = {}


def kept_kernels(model: Model) -> WordKernels:
    """Tables shared by the tasks that one worker process runs for the same model; those of other models go."""
    key = model.weights.tobytes() + "".join(model.landmarks).encode()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = WordKernels(model.landmarks, model.weights)
    return _KEPT[key]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `sample` documents per class outside the held-out fold, in a seeded order."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id")) != HELD_OUT)
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("o", F.md5(F.concat(F.lit("tox"), F.col("doc_id").cast("string"))))
    parts = [one.where(F.col("toxic") == v).orderBy("o").limit(sample) for v in (0, 1)]
    ids = stored(parts[0].union(parts[1]).select(F.col("doc_id").alias("id"), "toxic", "o"), "sample")
    # at most 2 * sample rows by construction
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("o").alias("o")
    )
    found = sorted(rows.where("text is not null").collect(), key=lambda r: r["o"])
    return [r["text"] for r in found], [int(r["toxic"]) for r in found]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts score as a sentence that matches nothing. Without labels of both classes every score is 0.
    Repeated rows score alike; an empty table gives an empty result.
    """
    model = train(*training_rows(docs, labels, sample))
    kind = dict(docs.dtypes)["doc_id"]

    def make() -> WordKernels | None:
        return kept_kernels(model) if model else None

    def run(batch: dict[str, list], kernels: WordKernels | None) -> dict[str, list]:
        texts = [units(t) for t in batch["text"]]
        value = model.scores(texts, kernels) if model else np.zeros(len(texts))
        return {"doc_id": batch["doc_id"], "score": value.tolist()}

    scored = map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, score double", run, make)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
