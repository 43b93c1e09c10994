"""Sharding, packing and neighbour search."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from tabloom.llm import hnsw, packing, sharding
from tabloom.llm.base import stored

# sharding ---------------------------------------------------------------------------------------------------------


def check_slots(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return by


def test_assignment(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.assign(docs).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data)) and r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    check_slots(rows)
    again = {r.doc_id: r.shard for r in sharding.assign(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.shard for r in rows}


def test_hash_spreads_evenly(spark):
    n = spark.range(24_000).select(sharding.winner(sharding.F.col("id"), 24).alias("s")).groupBy("s").count().collect()
    assert len(n) == 24 and all(850 < r["count"] < 1150 for r in n)


def test_buckets_shuffle_and_number(spark):
    rows = stored(spark.range(3000).selectExpr("id", "100L as size"), "rows")
    out = sharding.shuffled(rows, "id", "size", shards=3, bucket_bytes=5_000).select("row.id", "shard", "slot").collect()
    assert sorted(r.id for r in out) == list(range(3000))
    for shard in check_slots(out):
        ids = [r.id for r in sorted((r for r in out if r.shard == shard), key=lambda r: r.slot)]
        falls = sum(a > b for a, b in zip(ids, ids[1:])) / len(ids)
        assert 0.4 < falls < 0.6


def test_placement_is_that_of_written_documents(spark, edges, monkeypatch):
    paths = []
    scratch = sharding.scratch
    monkeypatch.setattr(sharding, "scratch", lambda spark, name: paths.append(scratch(spark, name)) or paths[-1])
    rows = sharding.assign(edges, shards=4).collect()
    back = spark.read.parquet(paths[-1])
    assert sorted(map(str, back.select("row.*").select(*[f"`{c}`" for c in edges.columns]).collect())) == sorted(map(str, edges.collect()))
    assert sorted((r.shard, r.slot, str(r.doc_id)) for r in back.select("shard", "slot", "row.doc_id").collect()) == sorted(
        (r.shard, r.slot, str(r.doc_id)) for r in rows)


def test_written_shards_hold_every_row(spark, edges, tmp_path):
    docs = edges.withColumnRenamed("shard", "own")
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s")).select(*[f"`{c}`" for c in docs.columns])
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


def test_sharding_of_odd_tables(edges, nothing):
    rows = sharding.assign(edges).collect()
    assert len(rows) == edges.count() and {r.size for r in rows if r.doc_id in (3, 4)} == {8}
    check_slots(rows)
    assert sharding.assign(nothing).collect() == []


# packing ----------------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    own, fast = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(6)
    pools = ["abc XYZ 019 .,;!?'\n\t", "äöüßéèñç ", "中文字符 かな 한국", "  \u0085\x0b\x0c\x1c\x00﻿", "😀👩‍🚀é ½²Ⅷ٣"]
    texts = ["", "a <|endoftext|> b", "I'll've they're", "   x", "x   ", "word" * 3000, " " * 3000]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        assert fast(t).tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.public_tokenizer())
    ids = {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs}
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and sum(p.length for p in parts) == len(ids[d])
        at = 0
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert all(p.length == 1024 for p in parts[1:]) and parts[0].length <= 1024
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return len(by_bin), sum(map(len, ids.values()))


@pytest.mark.parametrize("sequences", [1024, 40])
def test_pack(spark, tiny, sequences):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(3)
    bins, tokens = check_packing(packing.pack(docs, packing.public_tokenizer(), sequences=sequences).collect(), docs.collect())
    assert bins <= tokens / 1024 * 1.03 + tokens // 1024 // sequences + 2


def test_packing_of_odd_tables(edges, nothing):
    rows = packing.pack(edges, packing.public_tokenizer()).collect()
    one = edges.where("doc_id in (3, 4, 5, 6, 7, 8)")
    check_packing([r for r in packing.pack(one, packing.public_tokenizer()).collect()], one.collect())
    assert sum(r.doc_id == 2 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(nothing, packing.public_tokenizer()).collect() == []


def fewest(lengths, capacity):
    """Smallest number of bins by exhaustive search."""
    best = [len(lengths)]
    items = sorted(lengths, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                place(i + 1, bins[:b] + [bins[b] + items[i]] + bins[b + 1 :])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_local_search_against_exhaustive_search():
    rng = random.Random(8)
    start = found = best = 0
    for _ in range(60):
        lengths = [rng.randint(15, 60) for _ in range(11)]
        bins = packing.packed(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(11)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        start += len(packing.best_fit(list(range(11)), lengths, 100))
        found += len(bins)
        best += fewest(lengths, 100)
    assert best <= found <= start and found <= best + 6


def test_local_search_saves_sequences():
    rng = np.random.default_rng(1)
    lengths = rng.integers(200, 600, 2000).tolist()
    assert len(packing.packed(lengths)) < len(packing.best_fit(list(range(2000)), lengths, 1024))


# neighbours -------------------------------------------------------------------------------------------------------


def brute(ids, x, q, k=10):
    d = np.sqrt(np.square(x - x[q]).sum(1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


def compare(out, ids, x):
    by = collections.defaultdict(list)
    for r in out:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda r: (r[2], r[1]))
        at = list(ids).index(q)
        want = brute(ids, x, at)
        assert len(rows) == len(want)
        hits += len({v for v, _ in want} & {r[1] for r in rows})
        total += len(want)
        for _, v, s in rows:
            assert s == pytest.approx(np.sqrt(np.square(x[list(ids).index(v)] - x[at]).sum()), abs=1e-12)
    return by, hits / total


@pytest.mark.parametrize("rows", [8192, 120])
def test_recall(spark, rows):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = vectors.toPandas()
    graphs = hnsw.index(vectors, "vec_id", "embedding", rows=rows)
    out = hnsw.search(graphs, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding").collect()
    by, recall = compare(out, table.vec_id.values, np.array(table.embedding.tolist(), np.float64))
    assert len(by) == 25 and recall > 0.95


def test_recall_of_one_graph():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)) + rng.integers(0, 6, 4000)[:, None]
    graph = hnsw.Graph.build(x)
    q = graph.x[::40]
    found = graph.search(q, 10)
    true = np.argsort(((q[:, None].astype(np.float64) - graph.x[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), true.tolist())]) > 0.95
    back = hnsw.Graph.load(graph.x, **graph.flat())
    assert (back.search(q, 10) == found).all()


def test_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 1000, 10)] + [(1, [1.0, 2.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, same), (300, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    out = hnsw.nearest(vectors).collect()
    assert {r.query_id for r in out} == {0, 100, 200, 300, 400, 500, 600, 700, 800, 900}
    first = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == 100)
    assert first == [(i + 1, 10 * i, 0.0) for i in range(10)]
    few = hnsw.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in few) == [(1, 1, 1.0), (2, 2, 3.0)]
    assert hnsw.nearest(vectors.limit(0)).collect() == []


def test_slots_depend_on_the_seed_alone(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    key = "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(key), []
    for parts in (3, 11):
        spark.conf.set(key, str(parts))
        seen.append({(r.doc_id, r.shard, r.slot) for r in sharding.assign(docs.repartition(parts)).collect()})
    spark.conf.set(key, before)
    assert seen[0] == seen[1]


def test_fisher_yates_follows_its_definition(spark):
    F = sharding.F
    rows = spark.range(60).select("id", F.col("id").cast("int").alias("n"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(70)), lambda i: F.pmod(F.xxhash64(F.lit(5), "id", i), i + 1))
    for r in rows.select("n", sharding.fisher_yates(F.col("n"), F.lit(5), F.col("id")).alias("got"), draws.alias("draws")).where("n > 0").collect():
        order = list(range(r.n))
        for i in range(r.n - 1, 0, -1):
            j = r.draws[i]
            order[i], order[j] = order[j], order[i]
        assert r.got == order


def test_permutations_are_evenly_spread(spark):
    F = sharding.F
    got = spark.range(6000).select(sharding.fisher_yates(F.lit(3), F.lit(1), F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(got) == 6 and all(850 < r["count"] < 1150 for r in got)


def test_every_length_and_sum_of_a_bin_is_offered():
    lengths = [3, 5, 5, 9, 1]
    got = packing._gives(list(range(5)), lengths)
    want = {*lengths} | {a + b for i, a in enumerate(lengths) for b in lengths[:i]}
    assert set(got) == want and all(sum(lengths[i] for i in ids) == n for n, ids in got.items())
    assert all(len(got[n]) == 1 for n in lengths)


def test_search_goes_on_while_bins_empty():
    rng = __import__("random").Random(5)
    for top in (40, 400, 1000):
        lengths = [rng.randint(1, top) for _ in range(3000)]
        bins = packing.packed(lengths)
        assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sum(lengths[i] for i in b) for b in bins) <= 1024
        assert len(bins) <= -(-sum(lengths) // 1024) * 1.03 + 1


def test_vectors_of_any_finite_size(spark):
    rows = [(0, [1e25, 0.0]), (100, [2e25, 0.0]), (200, [1.0, 1.0]), (1, [3e25, 1e25]), (2, [1e-30, 2e-30]), (3, [1e300, -1e300]), (4, [3e-30, 2e-30]), (300, [1e-30, 1e-30]), (400, [1.2e308, 1.2e308])]
    got = {}
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, v in rows:
        if q % 100 == 0:
            hits = sorted(got[q])
            assert [(s, i) for _, i, s in hits] == sorted((s, i) for _, i, s in hits) and {i for _, i, _ in hits} == {i for i, _ in rows if i != q}
            for _, i, score in hits:
                far = math.hypot(*(a / 4 - b / 4 for a, b in zip(v, dict(rows)[i])))
                assert score / 4 == pytest.approx(far, rel=1e-12, abs=0)
    small = [(i, [i * 1e-30, (i * i % 7) * 1e-30]) for i in range(1, 120)]
    out = hnsw.nearest(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect()
    want = sorted((sum((a - b) ** 2 for a, b in zip([x * 1e30 for x in v], [y * 1e30 for y in small[99][1]])), i) for i, v in small if i != 100)[:10]
    assert len(out) == 10 and {r.vec_id for r in out} == {i for _, i in want}


def test_vectors_beside_clashing_columns(spark):
    rows = [(i, [float(i), 1.0], i, "x", 1) for i in range(1, 150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard long, v string, rank int")
    assert [r.vec_id for r in sorted(hnsw.nearest(df).collect(), key=lambda r: r["rank"])][:2] == [99, 101]
