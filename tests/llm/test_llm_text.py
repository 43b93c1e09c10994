"""Extraction, toxicity and the language model."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tabloom.llm import extract, lm, toxicity


# extraction -------------------------------------------------------------------------------------------------------

PAGES = {
    "<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One  two<br>three</p><p>A<b>b</b>c &amp; d</article><footer>f</footer></body>": "T One two three Abc & d",
    "<div class='menu'><a href=1>a</a><a href=2>b</a></div><div id=main><p>First long paragraph with many words in it.<p>Second paragraph, also long enough.</div><div class=comments><p>A reader says a lot of things here, more than the article itself, much more.</p></div>": "First long paragraph with many words in it. Second paragraph, also long enough.",
    "<body><script>var t='</p>';</script><style>p{}</style><p>Only text &lt;here&gt;&nbsp;now</p><form><input><p>mail</p></form></body>": "Only text <here> now",
    "plain words": "plain words",
    "<p>unclosed <b>bold <p>next": "unclosed bold next",
    "<!-- <p>no</p> --><p>yes</p><aside>side</aside>": "yes",
    "": "",
    "<div hidden><p>not shown</p></div><p>shown</p>": "shown",
    "<ul><li>one<li>two</ul>": "one two",
}


@pytest.mark.parametrize("html", PAGES)
def test_main_text(html):
    assert extract.main_text(html) == PAGES[html]


def test_links_weigh_against_a_block():
    menu = "".join(f"<li><a href=/{i}>some menu entry {i}</a></li>" for i in range(30))
    text = "".join(f"<p>Sentence number {i} of the running text, which is not linked anywhere.</p>" for i in range(8))
    out = extract.main_text(f"<body><div><ul>{menu}</ul></div><div>{text}</div></body>")
    assert out.startswith("Sentence number 0") and "menu" not in out and out.endswith("anywhere.")


LONG = "".join(f"<p>Sentence number {i} of the running text, which is not linked anywhere.</p>" for i in range(4))
WRAPPED = [
    f"<body><div {a}>{LONG}</div><p>x</p></body>"
    for a in ("class=content-sidebar-wrap", "class='has-sidebar'", "class='overflow-hidden'", "id=page-with-menu", "class=no-comments", 'style="overflow: hidden"',
              'title="a hidden gem"', "class='sidebar'", "class='col hidden'")
] + [f"<div class='{c}'><article>{LONG}</article></div><div class=ad>{LONG.replace('Sentence', 'Advert')}{LONG}</div>" for c in ("sidebar", "comments", "modal")]


@pytest.mark.parametrize("html", WRAPPED + [f"<form id=f>{LONG}<nav>m</nav></form>"])
def test_names_do_not_cut_the_article(html):
    out = extract.main_text(html)
    assert all(f"Sentence number {i} " in out for i in range(4)) and "Advert" not in out


@pytest.mark.parametrize("name", ["ad", "sidebar", "ad-1", "social-share", "x related"])
def test_names_still_cut_other_parts(name):
    assert "Extra" not in extract.main_text(f"<body><div>{LONG}<div class='{name}'><p>Extra words that are not in the article.</p></div></div></body>")


ITEM = "Item number {} of the list between the parts, which is as long as any sentence of the text."
BETWEEN = [
    "<ul>" + "".join(f"<li>{ITEM.format(i)}</li>" for i in range(5)) + "</ul>", "<dl>" + "".join(f"<dd>{ITEM.format(i)}</dd>" for i in range(5)) + "</dl>",
    "<table>" + "".join(f"<tr><td>{ITEM.format(i)} {ITEM.format(i)}</td></tr>" for i in range(5)) + "</table>",
    " ".join(ITEM.format(i) for i in range(5)), "<br>".join(f"{ITEM.format(i)} <b>b</b>" for i in range(5)),
    "<figure>" + " ".join(ITEM.format(i) for i in range(5)) + "</figure>",
]


@pytest.mark.parametrize("between", BETWEEN)
def test_blocks_between_parts_of_a_split_article(between):
    part = "".join(f"<p>Sentence number {i} of the running text, which is not linked to anywhere.</p>" for i in range(8))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>menu entry {i} that leads to another page of this place</a></li>" for i in range(9)) + "</ul>"
    out = extract.main_text(f"<body>{menu}<div><div>{part}</div>{between}<div>{part}</div></div></body>")
    assert out.count("Sentence number") == 16 and all(f"Item number {i} " in out for i in range(5)) and "menu" not in out


def test_pages(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    out = extract.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == pages.count()
    assert all(r.n_chars == len(r.text) and r.n_chars > 0 and "<p>" not in r.text for r in out.collect())
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>" * 3000 + "deep")], "page_id long, url string, html string")
    assert [r.text for r in extract.extract(odd).collect()] == ["", "", "deep"]
    assert extract.extract(odd.limit(0)).collect() == []


# toxicity ---------------------------------------------------------------------------------------------------------


def slow_kernel(s, t):
    def weights(x):
        out = collections.Counter()
        for at in itertools.combinations(range(len(x)), toxicity.ORDER):
            out["".join(x[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[u] for u, v in a.items())


def test_kernel():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    marks = [w for w in words if len(w) >= 3][:9]
    got = toxicity.WordKernels(marks).of(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            own = slow_kernel(w, w) * slow_kernel(m, m)
            assert got[i, j] == pytest.approx(slow_kernel(w, m) / math.sqrt(own) if slow_kernel(w, w) else 0, abs=1e-5)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(out) == docs.count()
    held = [(out[r.doc_id].predicted, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    hits = sum(p and y for p, y in held)
    assert hits / sum(y for _, y in held) > 0.85 and hits / sum(p for p, _ in held) > 0.85
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= out[d].score <= 1 for d in out)
    assert all((r.score >= 0.7) == bool(r.predicted) for r in out.values())


def test_gaps_are_tolerated():
    rng = random.Random(1)
    usual = ["house", "garden", "river", "winter", "paper", "light", "morning", "stone", "what", "an", "you", "are", "the"]
    texts = [" ".join(rng.choices(usual, k=20)) + ". " for _ in range(80)]
    insult = lambda: [rng.choice(["idiot", "moron"])]
    bad = [" ".join(rng.choices(usual, k=10) + insult() + rng.choices(usual, k=10)) + ". " for _ in range(80)]
    model = toxicity.train(texts + bad, [0] * 80 + [1] * 80, count=16)
    tables = toxicity.WordKernels(model.landmarks, model.weights)
    score = lambda t: model.scores([t.split()], tables)[0]
    assert score("what an idiot you are") > 0.7 and score("what an i.d.i.o.t") > 0.7 and score("the garden house") < 0.3
    assert score("what an idxiot") > 0.7 and score("") < 0.3


def test_toxicity_of_odd_tables(edges, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (None, 1), (2, None), (99, 0), (1, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        rows = toxicity.score(edges, labels).collect()
        assert len(rows) == edges.count() and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.score(nothing, odd).collect() == []


# language model ---------------------------------------------------------------------------------------------------


def base(rows):
    """(n_tokens, n_known, base_score) by (doc_id, text), and N."""
    counts = collections.Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    for d, t in rows:
        if not held(d):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    score = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    return {(d, t): (held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, score(t)) for d, t in rows}


@pytest.mark.parametrize("head,size", [(1 << 20, 1 << 27), (50, 1 << 27), (1 << 20, 4096)])
def test_base_score(spark, tiny, head, size):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(3)
    rows = docs.select("doc_id", "text").collect()
    want = base([(r.doc_id, r.text) for r in rows])
    texts = {r.doc_id: r.text for r in rows}
    out = lm.score(docs, size, head).collect()
    assert len(out) == len(rows)
    for r in out:
        w = want[r.doc_id, texts[r.doc_id]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)


def test_filter_too_large_to_broadcast_keeps_every_bigram(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(3)
    want = {r.doc_id: r for r in lm.score(docs, head=50).collect()}
    for chunk in (20_000, 1 << 22):
        got = lm.score(docs, 4096, 50, chunk).collect()
        assert len(got) == len(want)
        assert all(r.score == pytest.approx(want[r.doc_id].score, rel=1e-12) and r.n_known == want[r.doc_id].n_known for r in got)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    hashes, shift = np.unique(rng.integers(0, 2**64, 20_000, np.uint64, endpoint=False)), 5
    counts = rng.geometric(0.3, len(hashes)) ** 2
    bucket, key = lm._parts(hashes, shift)
    parts = [(b, lm._segment(b, key[bucket == b], counts[bucket == b], 1)) for b in range(32)]
    bloom = lm.Filter(parts, shift)
    levels, true = bloom.levels(hashes), lm.level_of(counts)
    assert (levels >= true).all() and (levels > true).mean() < 0.03
    assert (bloom.levels(rng.integers(0, 2**64, 20_000, np.uint64, endpoint=False)) > 0).mean() < 0.03


def test_levels_of_counts():
    counts = np.arange(0, 5000)
    levels = lm.level_of(counts)
    assert levels[0] == 0 and levels[1] == 1 and (np.diff(levels) >= 0).all()
    mean = lm.MEAN[levels[1:]]
    assert (np.abs(mean - counts[1:]) <= 0.5 * counts[1:]).all() and lm.MEAN[1] == 1


def test_language_model_of_odd_tables(edges, nothing):
    rows = lm.score(edges).collect()
    want = base([(r.doc_id, r.text) for r in edges.collect()])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in rows) == sorted((str(r.doc_id), *want[r.doc_id, r.text][1:3]) for r in edges.collect())
    assert lm.score(nothing).collect() == []
    lone = edges.where("doc_id = 3").selectExpr("30 as doc_id", "text", "lang")
    assert lm.score(lone).count() == 1


@pytest.mark.parametrize("page", ["<a " * 350_000, "<title>" * 150_000, "<div>" * 60_000 + "</span>" * 60_000, "<b>" * 60_000 + "<p></p>" * 40_000,
                                  "<!-- x" * 150_000, "<a \"'>" * 150_000, "<li>" * 40_000 + "<b>" * 40_000 + "<td>" * 40_000])
def test_broken_markup_costs_linear_time(page):
    t = __import__("time").process_time()
    extract.Page(page)
    assert __import__("time").process_time() - t < 8


def test_tags_and_comments_without_an_end():
    read = lambda s: "".join(extract.Page(s).runs)
    assert read("a<b>c</b>d <e").split() == ["acd", "<e"]
    assert read("a <b>c</b> d <!-- gone > too").split() == ["a", "c", "d"]
    assert read("a <!-- gone <b>x").split() == ["a"] and read("1 < 2 > 0").split() == ["1", "<", "2", ">", "0"]


def test_pages_beside_clashing_columns(spark):
    html = "<html><body><nav>menu</nav><article><p>" + "some article text " * 20 + "</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", html, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    r = extract.extract(df).first()
    assert r.text == ("some article text " * 20).strip() and r.n_chars == len(r.text)


def test_units_of_a_text():
    assert toxicity.units("plain words only here.") == ["plain", "words", "only", "here."]
    assert toxicity.units("you i d i o t. end") == ["you", "idiot", "i", "d", "i", "o", "t.", "end"]
    assert toxicity.units(None) == [] == toxicity.units(" ")
    long = "".join(chr(97 + i % 26) for i in range(1000))
    cut = toxicity.units(f"a {long} b")
    assert cut[0] == "a" and cut[-1] == "b" and max(map(len, cut)) <= toxicity.LONG
    assert all(any(long[i : i + 12] in c for c in cut) for i in range(988))


def test_long_words_and_spaced_letters():
    rng = random.Random(3)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(3, 8))) for _ in range(300)]
    say = lambda *more: " ".join(rng.choices(words, k=14) + list(more) + rng.choices(words, k=6)) + "."
    model = toxicity.train([say() for _ in range(90)] + [say("blockhead") for _ in range(90)], [0] * 90 + [1] * 90, count=16)
    tables = toxicity.WordKernels(model.landmarks, model.weights)
    of = lambda t: float(model.scores([toxicity.units(t)], tables)[0])
    clean = max(of(say()) for _ in range(20))
    assert of(say("b l o c k h e a d")) > clean and of(say("blo", "ck", "he", "ad")) >= 0
    assert of("".join(rng.choices(words, k=40)) + "blockhead" + "".join(rng.choices(words, k=40))) > clean
    t = __import__("time").process_time()
    of("".join(rng.choices("aeioulmnrst", k=200_000)))
    assert __import__("time").process_time() - t < 6
