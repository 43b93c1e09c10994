"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from tabloom.llm import phrases


def expected(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    over = {}
    for p, a in frequent.items():
        w = p[1:]
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    over[p[0], *w[i:j]] = max(a, over.get((p[0], *w[i:j]), 0))
    found = {}
    for p, a in frequent.items():
        lang, w = p[0], p[1:]
        if 100 * over.get(p, 0) < 80 * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))  # noqa: E741
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {
        (lang, k): (s[2].decode(), -s[1], s[3], s[4], n[lang], -s[0]) for lang, all_ in found.items() for k, s in enumerate(sorted(all_)[:top], 1)
    }


def got(df):
    rows = df.collect()
    out = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed, docs, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Über", "a\x1cb", "x-y"]
    fixed = [rng.choices(words, k=rng.randint(2, 6)) for _ in range(12)]
    rows = []
    for _ in range(docs):
        text = []
        for _ in range(rng.randint(0, 20)):
            text += rng.choice(fixed) if rng.random() < 0.4 else rng.choices(words, k=rng.randint(1, 6))
            text.append(rng.choice(["", "", ".", ",", "\n", "\t", " ? "]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), " ".join(text).replace("w1 ", "W1 ")))
    return rows


@pytest.mark.parametrize("seed,least,top,vocabulary", [(1, 4, 5, 30), (2, 3, 40, 12), (3, 2, 4000, 60)])
def test_plain_version(spark, monkeypatch, seed, least, top, vocabulary):
    monkeypatch.setattr(phrases, "LEAST", least)
    monkeypatch.setattr(phrases, "TOP", top)
    rows = corpus(seed, 250, vocabulary)
    want = expected(rows, least, top)
    assert want and got(phrases.mined(spark.createDataFrame(rows, "lang string, text string").repartition(5))) == want


def test_bound_is_admissible():
    """No extension of a prefix scores above the bound the frontier gives it."""
    rows = corpus(4, 200, 15)
    f = Counter()
    for _, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    for p, a in f.items():
        if len(p) > 2:
            score = min(2_000_000 * a // (f[p[:k]] + f[p[k:]]) for k in range(1, len(p)))
            assert all(score <= 2_000_000 * f[p[:k]] // (f[p[:1]] + f[p[:k]]) for k in range(2, len(p)))


def test_exact_beyond_64_bits(spark):
    big = 1 << 62
    row = spark.createDataFrame([(big, big + 3, big + 9)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s")).first()
    assert row.s == 2_000_000 * big // (2 * big + 12)


def test_edges(spark, monkeypatch, edges, nothing):
    monkeypatch.setattr(phrases, "LEAST", 2)
    rows = [(r.lang, r.text) for r in edges.collect()]
    assert got(phrases.mined(edges)) == expected(rows, 2, phrases.TOP)
    assert phrases.mined(nothing).collect() == []
