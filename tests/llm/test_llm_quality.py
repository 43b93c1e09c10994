"""Quality rules and mixing against SQL, and both on odd tables."""

import parity
import pytest

from tabloom.llm import ORACLES, QUERIES, mixing, quality


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, tiny, name):
    assert parity.compare(QUERIES[name](spark, tiny), parity.connect(tiny), ORACLES[name]) is None


def repeated(words):
    seen, where = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            where.update(p + k for p in places for k in range(8))
    return len(where)


def test_metrics_of_odd_texts(edges):
    got = {(r.doc_id, r.n_words): r for r in quality.assess(edges).collect()}
    for row in edges.collect():
        text = row.text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        r = got[row.doc_id, len(words)]
        assert (r.word_chars, r.n_repeat_words) == (sum(map(len, words)), repeated(words))
        assert r.base_failed == (len(words) < 20 or 100 * repeated(words) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_lines_and_symbols(spark):
    text = "a # b\n\nc\na # b\n \t\na # b \nc|<>&%$*"
    r = quality.assess(spark.createDataFrame([(1, text, "en", "s")], "doc_id int, text string, lang string, source string")).first()
    assert (r.n_dup_lines, r.n_symbols) == (1, 10)


def test_kept_rows_keep_their_columns(edges, nothing):
    out = quality.kept(edges)
    assert out.columns == edges.columns and {r.doc_id for r in out.collect()} <= {1, 2}
    assert quality.kept(nothing).collect() == [] == quality.assess(nothing).collect()


def test_fence_follows_source_then_language_then_all(spark):
    rows = [(i, "aaaa " * 5 + f"b{i} " * 1 + " ".join(f"w{i}x{k}" for k in range(30)), "en", "big") for i in range(200)]
    rows += [(1000, " ".join(f"q{k}#" for k in range(40)), "en", "small"), (1001, " ".join(f"q{k}" for k in range(40)), "xx", None)]
    out = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[0] and out[1001] and not out[1000]


def test_buckets_are_ordered_and_near(spark):
    df = spark.range(0, 5000).select("id", quality._bucket(quality.F.col("id")).alias("b"))
    rows = df.select("id", "b", quality._edge(quality.F.col("b")).alias("e")).orderBy("id").collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:]))
    assert all(r.e <= r.id <= r.e + r.e // 32 for r in rows)


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # domain a: en has too little for its share, de takes it; domain b is untouched
    got = {r.lang + r.source: r.budget for r in mixing.budgets(leaves(spark, [
        ("web", "en", "s", 100), ("web", "de", "s", 100_000), ("books", "en", "t", 100_000)]), share=0.1, epochs=1).collect()}
    total = 200_100 * 0.1
    assert got["ens"] == 100 and got["des"] == pytest.approx(total * 6 / 9 - 100, abs=1) and got["ent"] == pytest.approx(total * 3 / 9, abs=1)
    # nothing left in the whole domain: its rest moves to the other domain
    got = {r.source: r.budget for r in mixing.budgets(leaves(spark, [("web", "en", "s", 100), ("books", "en", "t", 100_000)]), share=0.1, epochs=1).collect()}
    assert got["s"] == 100 and got["t"] == pytest.approx(100_100 * 0.1 - 100, abs=1)


def test_copies_keep_within_the_budget(edges, nothing):
    out = mixing.mixed(edges, share=1.5, epochs=3)
    assert out.count() == edges.count()
    sums = out.groupBy("domain", "lang", "source").agg(mixing.F.sum(mixing.F.col("copies") * mixing.F.col("n_tokens")).alias("used"), mixing.F.max("leaf_budget").alias("b"))
    assert all(r.used <= r.b for r in sums.collect())
    assert mixing.mixed(nothing).collect() == [] == mixing.sampled(nothing).collect()
    assert mixing.sampled(edges).columns == edges.columns


def test_sampled_repeats_rows_by_epoch(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en", "src0") for i in range(50)], "doc_id long, text string, lang string, source string")
    n = {}
    for r in mixing.sampled(docs, share=2.3, epochs=3).collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert len(n) == 50 and sum(n.values()) == 115 and set(n.values()) == {2, 3}


def test_leaf_without_tokens_is_taken_like_in_sql(spark):
    import duckdb

    rows = [(1, "a b c d", "en", "src1"), (2, "e f g h", "en", "src1"), (3, "", "en", "src2"), (4, None, "en", "src2"), (5, " ", "de", "src3"), (6, "", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r[-1] for r in con.execute(ORACLES["op4_source_mixing"]).fetchall()}
    got = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    assert got == want and got[3] == got[4] == got[5] == 1
    assert {3, 4, 5} <= {r.doc_id for r in mixing.sampled(docs).collect()}
