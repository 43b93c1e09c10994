"""Near-duplicate groups against a comparison of all pairs."""

import random

import numpy as np
import pytest

from tabloom.llm import minhash
from tabloom.llm.shingles import WordHashes, shingle_set


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """component by doc_id of rows (doc_id, text), all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return {d: (len(sets[i]), first[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, groups, most, words):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(1, words))
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\t "]).join(own).replace("v1", "V1"))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,groups,most,words", [(1, 60, 8, 120), (2, 200, 3, 12), (3, 2, 160, 150)])
def test_brute_force(spark, seed, groups, most, words, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = corpus(seed, groups, most, words)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = expected(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_signature_matches_at_the_rate_of_the_similarity():
    rng = np.random.default_rng(5)
    rates = []
    for size in (4, 40, 400):
        agree = []
        for _ in range(200):
            pool = rng.integers(0, 2**64, size + size // 4 * 2, np.uint64, endpoint=False) if size > 4 else rng.integers(0, 2**63, 5).astype(np.uint64)
            a, b = np.unique(pool[: len(pool) - len(pool) // 6]), np.unique(pool[len(pool) // 6 :])
            similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean() - similarity)
        rates.append(abs(np.mean(agree)))
    assert max(rates) < 0.03


def test_bridges_find_every_link_between_labels():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.sort(np.unique(np.concatenate([base[k : k + 60], base[:20]]))) for k in range(0, 40, 4)]
    found = list(minhash._bridges(sets, list(range(len(sets)))))
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    assert found and all(any(near(sets[i], sets[j]) for i in range(10) for j in range(i)) for _ in found)
    assert len(found) == 9 - sum(not near(sets[i], sets[i + 1]) for i in range(9))


def test_contraction_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "u long, v long")
    labels = {r.node: r.label for r in minhash.contracted(edges).collect()}
    assert len({labels[i] for i in range(61)}) == 1 and labels[100] == labels[101] != labels[0]


def test_edges(edges):
    out = minhash.near_duplicates(edges).collect()
    assert len(out) == edges.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[1] == [(17, 1, True)] and by[2] == [(17, 1, False)] * 2
    assert by[6][0][1] == by[7][0][1] == 6
    assert all(c is None and k for _, c, k in by[None])
    kept = minhash.deduplicated(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 9, 9]
    assert sum(r.doc_id is None for r in rows) == 1


def test_nothing(nothing):
    assert minhash.near_duplicates(nothing).collect() == [] and minhash.deduplicated(nothing).collect() == []


def test_shingles_of_short_and_empty_texts():
    h = WordHashes()
    assert [len(shingle_set(t, h)) for t in (None, "", "a", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a")] == [0, 0, 1, 1, 1, 2, 1]
    assert (shingle_set("A BÄ c", h) == shingle_set("a bÄ  c ", h)).all()
