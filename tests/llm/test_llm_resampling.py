"""Importance resampling against a plain version, and the radix sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tabloom.llm import resampling
from tabloom.llm.base import stored


def features(text, widest):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % resampling.BUCKETS for k in range(1, widest + 1) for i in range(len(w) - k + 1)]


def expected(docs, target, widest=1, percent=10, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, widest)[1])
    for text in target:
        t.update(features(text, widest)[1])
    m, all_s, all_t = resampling.BUCKETS, sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + m) / ((s[b] + 1) * (all_t + m))))
    rows = []
    for doc, text in docs:
        n, found = features(text, widest)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in found)
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {}
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(r[:4], []).append(k)
    return sorted((r[:4] + ((ranks[r[:4]].pop(0) if ranks.get(r[:4]) else None),) for r in rows), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("widest,percent,parts", [(1, 10, 3), (3, 40, 7)])
def test_plain_version(spark, widest, percent, parts):
    rng = random.Random(widest)
    words = [f"w{i}" for i in range(300)] + ["Ä", "éa", "X9"]
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(400)]
    target = [" ".join(rng.choices(words[:40], k=30)) for _ in range(20)] + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resampling.resampled(df, aim, percent=percent, widest=widest)) == expected(docs, target, widest, percent)


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert got(resampling.resampled(edges, edges, percent=100)) == expected(rows, [t for _, t in rows], percent=100)
    assert got(resampling.resampled(edges, nothing)) == expected(rows, [])
    assert resampling.resampled(nothing, edges).collect() == [] == resampling.resampled(nothing, nothing).collect()


@pytest.mark.parametrize("kind", ["wide", "narrow", "same"])
def test_radix_order(spark, kind):
    rng = random.Random(3)
    pick = {"wide": lambda: rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, rng.getrandbits(60)]), "narrow": lambda: rng.randint(-5, 5000), "same": lambda: 7}[kind]
    rows = [(pick(), rng.choice([pick(), 1, 2]), i) for i in range(3000)]
    df = stored(spark.createDataFrame(rows, "a long, b long, tag long").repartition(5), "rows")
    out = resampling.radix_ranked(df, ["a", "b"], block=256).collect()
    assert sorted(r.place for r in out) == list(range(3000)) and sorted(r.tag for r in out) == list(range(3000))
    assert [(r.a, r.b) for r in sorted(out, key=lambda r: r.place)] == sorted((a, b) for a, b, _ in rows)


def test_result_does_not_depend_on_partitions(spark, tiny):
    docs, aim = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(resampling.resampled(docs.repartition(2), aim)) == got(resampling.resampled(docs.repartition(9), aim))
