"""The metric join against a comparison of all pairs, and its windows and cuts by themselves."""

import random

import numpy as np
import pytest

from tabloom.llm import base, metric
from tabloom.llm.shingles import WordHashes, hashed_words, shingle_set, text_shingles


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return {d: (len(sets[i]), first[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, groups, most, words, vocabulary=500, change=40):
    rng = random.Random(seed)
    known = [f"v{i}" for i in range(vocabulary)]
    texts = []
    for _ in range(groups):
        base = rng.choices(known, k=rng.randint(1, words))
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // change))):
                own[rng.randrange(len(own))] = rng.choice(known)
            texts.append(rng.choice([" ", "\n", "\t "]).join(own[: len(own) - rng.randint(0, len(own) // 20)]).replace("v1", "V1"))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(
    "seed,groups,most,words,vocabulary,change,sample",
    [(1, 60, 8, 150, 500, 40, 512), (2, 300, 4, 14, 500, 40, 512), (3, 2, 200, 200, 500, 30, 0), (4, 40, 12, 60, 3, 20, 512), (5, 120, 4, 60, 900, 60, 0)],
)
def test_brute_force(spark, seed, groups, most, words, vocabulary, change, sample, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK", 16)
    if seed == 2:  # as if many classes stayed empty: depths are asked for
        monkeypatch.setattr(metric, "EXTRA", ())
    if not sample:
        monkeypatch.setattr(metric, "chosen_pivots", lambda docs: metric.Pivots([]))
    rows = corpus(seed, groups, most, words, vocabulary, change)
    out = metric.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected(rows)


def linked_pairs(seed, sizes):
    rng = np.random.default_rng(seed)
    for n in sizes:
        x = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
        for _ in range(20):
            out = int(rng.integers(0, metric.most_apart(len(x)) + 1))
            y = np.unique(np.append(rng.permutation(x)[out // 2 :], rng.integers(0, 2**63, out - out // 2).astype(np.uint64)))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                yield x, y


@pytest.mark.parametrize("fill,extra", [(4.5, metric.EXTRA), (5.6, ()), (9, ((40, 1),))])
def test_linked_sets_share_a_region_of_each_level(fill, extra, monkeypatch):
    monkeypatch.setattr(metric, "FILL", fill)
    monkeypatch.setattr(metric, "EXTRA", extra)
    pairs = list(linked_pairs(1, [*range(1, 90), 150, 170, 400, 1000]))
    assert len(pairs) > 500
    asked = sorted({(len(x), k) for p in pairs for x in p if (k := metric.finer(x)) is not None})
    assert asked or fill < 5
    for x, y in pairs:
        cuts = [metric.own_depths(len(s)) + metric.asked_depths(len(s), asked) for s in (x, y)]
        keys = [{int(k) for d in c for k in metric.projections(s, d)} for c, s in zip(cuts, (x, y))]
        assert np.array_equal(x, y) or keys[0] & keys[1]
        assert all(len(metric.projections(x, d)) <= metric.most_apart(len(x)) + 1 for d in cuts[0])


def test_windows_lose_no_linked_pair():
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 2**64, 200, np.uint64, endpoint=False)) for _ in range(6)]
    pivots = metric.Pivots(base)
    met = set()
    for _ in range(600):
        a, b = base[rng.integers(6)], base[rng.integers(6)]
        own = np.append(rng.permutation(a)[: rng.integers(0, 200)], rng.permutation(b)[: rng.integers(0, 200)])
        x = np.unique(np.append(own, rng.integers(0, 2**63, 20).astype(np.uint64)))
        y = np.unique(np.append(rng.permutation(x)[len(x) // 13 :], rng.permutation(a)[: len(x) // 14]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            (p, r), (q, s) = pivots.placed(x), pivots.placed(y)
            assert set(r) & set(s)
            met |= {len(r), len(s)}
        want = [len(np.intersect1d(x, z)) for z in base]
        assert pivots.shared(x).tolist() == want
    assert max(met) > 1


def test_bridges_connect_what_is_linked():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 60).astype(np.uint64)) for _ in range(5)]
    sets += [np.unique(np.append(s[3:], np.uint64(900 + i))) for i, s in enumerate(sets)]
    found = list(metric.bridges(sets, list(range(10))))
    assert sorted(tuple(sorted(p)) for p in found) == [(i, i + 5) for i in range(5)]


def test_hopeful_sets_include_all_that_link():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False)) for n in (20, 60, 300, 2000)]
    sets += [np.unique(np.append(s[len(s) // 20 :], rng.integers(0, 2**63, len(s) // 30).astype(np.uint64))) for s in sets]
    got = metric.hopeful([metric.folded(s) for s in sets], list(range(8)))
    assert (got >= 0).all() and (got[:4] == got[4:]).all()
    apart = metric.hopeful([metric.folded(s) for s in sets], [0, 1, 2, 3, 0, 1, 2, 3])
    assert (apart[:3] < 0).all() and metric.hopeful([metric.folded(sets[0]), b""], [1, 2]).tolist() == [0, 0]


def test_edges(edges, nothing):
    out = metric.joined(edges).collect()
    assert len(out) == edges.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)]
    assert by[1] == [(18, 1)] and by[2] == [(18, 1)] * 2 and by[6][0][1] == by[7][0][1] == 6
    assert [c for _, c in by[None]] == [None, None] and [c for _, c in by[9]] == [9, 9]
    assert metric.joined(nothing).collect() == []


def test_short_texts():
    h = WordHashes()
    assert [len(shingle_set(t, h, 4)) for t in (None, "", "a", "a b c", "a b c d", "a b c d e", "a a a a a a")] == [0, 0, 1, 1, 1, 2, 1]


def test_tables_are_deleted_when_nothing_reads_them(spark, tmp_path, monkeypatch):
    """Keys, regions and full sets are many times the result: they must not stay on disk until the end."""
    names = []
    monkeypatch.setattr(base, "scratch", lambda _, name: names.append(name) or f"{tmp_path}/{name}-{len(names)}")
    rows = corpus(1, 40, 6, 100)
    out = metric.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert {"signatures", "own", "regions", "sets"} <= set(names) and {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected(rows)
    assert not {"signatures", "own", "labelled", "sets"} & left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_word_hashes_tell_words_apart_as_a_split_does():
    known = {}
    long = "q" * 100
    for text in (None, "", " \t\n", "a", "A a", "ab a b ba  aab", f"x\x0b{long} y {long}Z {long}z", "\u00c4\u00e4 \u00a0x \ud800 aa", "w1 " * 50 + "w2"):
        words = (text or "").encode("utf-8", "replace").lower().split()
        got = hashed_words(text).tolist()
        assert len(got) == len(words)
        for word, value in zip(words, got):
            assert known.setdefault(word, value) == value
        assert len(text_shingles(text, 4)) == len(shingle_set(text, WordHashes(), 4))
    assert len(set(known.values())) == len(known)


def test_what_many_unlike_texts_hold_makes_no_region():
    """Single shingles, or a line of a tenth of the texts, brought unlike texts together: that grows with the square of the input."""
    rng = np.random.default_rng(11)
    new = lambda n: rng.integers(0, 2**64, n, np.uint64, endpoint=False)
    single, line = new(40), new(10)
    common = metric.Common([(int(x.astype(np.int64)), 3) for x in line])
    for n, extra in ((300, single), (30, line)):
        sets = [np.unique(np.concatenate([new(n), rng.permutation(extra)[:10]])) for _ in range(400)]
        keys = np.concatenate([np.unique(np.concatenate([metric.projections(s, k, common.rarity(s)) for k in metric.own_depths(len(s))])) for s in sets])
        assert len(keys) > 5000 and len(keys) - len(np.unique(keys)) < 10


def test_common_shingles_leave_the_links(spark, monkeypatch):
    monkeypatch.setattr(metric, "COMMON_TEXTS", 2)
    rng = random.Random(3)
    lines = [" ".join(rng.choices("abcdefgh", k=12)) for _ in range(3)]
    rows = [(i, f"{t}\n{rng.choice(lines)}" if i % 3 else rng.choice(lines)) for i, t in corpus(6, 60, 6, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = metric.common_shingles(metric.sampled(docs, 4096))
    assert len(known.shingles) > 20 and (known.rarity(text_shingles(lines[0], 4)) < metric.RARE).all()
    assert (known.rarity(text_shingles("never met in any text", 4)) == metric.RARE).all()
    out = metric.joined(docs).collect()
    assert len(out) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected(rows)


def test_overlapping_regions_are_dealt_out_once(spark, monkeypatch):
    """Forty nodes that share thirty regions are three blocks, not three blocks in every ring of each region."""
    monkeypatch.setattr(metric, "BLOCK", 16)
    made, dealt = [], metric._dealt
    monkeypatch.setattr(metric, "_dealt", lambda rows: made.append(dealt(rows).count()) or dealt(rows))
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**64, 50, np.uint64, endpoint=False)) for i in range(20)]
    sets += [np.unique(np.append(s[1:], np.uint64(i))) for i, s in enumerate(sets)]
    full = [(i, s.tobytes(), metric.folded(s)) for i, s in enumerate(sets)]
    own = [(k, int(k == 0), i, i, 50) for k in range(30) for i in range(40) if i != k]
    found = metric._rings(
        spark.createDataFrame(own, "key long, center long, label long, node long, n long"),
        spark.createDataFrame(full, "node long, members binary, cells binary"),
    )
    assert sorted(tuple(sorted((r.u, r.v))) for r in found.distinct().collect()) == [(i, i + 20) for i in range(20)]
    assert made[0] == 40 * 3
