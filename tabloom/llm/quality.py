"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

Every rule has an integer value per document (parts per thousand). Values fall into buckets of at most 1/32 relative
width, and the counts per (language, source, rule, bucket) are the sketch: two sketches merge by adding counts, so
partial sums before the shuffle, sources rolled up into languages and new shards added later all give the same result as
one pass. Upper fences follow from the quartiles of a sketch. A source with too few documents takes the fence of its
language, and a language with too few the fence of the whole table; fences are then joined to the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.base import SPACES, boxed, stored, unboxed, words

#: rule: (numerator, denominator, least spread in parts per thousand). A fence is q3 + REACH * max(q3 - q1, spread).
RULES = {
    "symbols": ("n_symbols", "n_words", 150),
    "dup_lines": ("n_dup_lines", "n_lines", 250),
    "repeats": ("n_repeat_words", "n_words", 140),
    "capitals": ("n_capitals", "word_chars", 120),
    "word_length": ("word_chars", "n_words", 1000),
}
REACH = 2
LEAST_DOCUMENTS = 100
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Bind `value` once: inside a lambda a plain expression would be evaluated for every element."""
    return F.transform(F.array(value), then)[0]


def _windows(hashes: Column) -> Column:
    each = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - 7), lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(8)])
    )
    return F.when(F.size(hashes) >= 8, each)


def _starts(ordered: Column) -> Column:
    """Places of windows with a neighbour of equal hash, from (hash, place) in order."""
    like = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
    marked = F.transform(ordered, lambda x, i: F.when(like(x, i - 1) | like(x, i + 1), x["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _covered(starts: Column) -> Column:
    """Length of the union of [s, s + 8) over ascending starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, s: F.struct(s.alias("last"), (a["sum"] + F.least(F.lit(8), s - a["last"])).alias("sum")),
    )["sum"]


def _repeated(words_: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the document.

    Windows are compared by 64-bit hashes. Only documents that repeat a window pay for locating them.
    """

    def count(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(_let(pairs, lambda o: _covered(_starts(o))))

    hashes = F.transform(words_, lambda w: F.xxhash64(w))
    return F.coalesce(_let(hashes, lambda h: _let(_windows(h), count)), F.lit(0).cast("long"))


def measured(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """Add the metrics of whole texts: the base columns, `n_lines` and `n_capitals`. Null texts count as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select(*keep, t.alias("t"), words(text).alias("w"), lines.alias("lines"))
    size = lambda c: F.size(c).cast("long")
    length = lambda c: F.length(c).cast("long")
    names = [c for c in df.columns if c not in ("t", "w", "lines")]
    return df.select(
        *names,
        size("w").alias("n_words"),
        length(F.translate("t", SPACES, "")).alias("word_chars"),
        (length("t") - length(F.translate("t", "#*$%&|<>", ""))).alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeated(F.col("w")).alias("n_repeat_words"),
        size("lines").alias("n_lines"),
        (length("t") - length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _bucket(v: Column) -> Column:
    """Exact integer bucket: the value itself below 64, else the five bits below the leading one."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", v, shift)).cast("int")


def _edge(b: Column) -> Column:
    """Smallest value of a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - 32 * shift).cast("long"), shift)


def values() -> dict[str, Column]:
    """Parts per thousand of each rule, in whole numbers."""
    return {
        rule: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long") for rule, (a, b, _) in RULES.items()
    }


def sketches(metrics: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) over the documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), _bucket(v).alias("bucket")) for k, v in values().items()]))
    long = metrics.where(~base_failed()).select("lang", "source", pairs.alias("p"))
    return long.groupBy("lang", "source", "p.rule", "p.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with a fence per rule, by source, language or whole table as their counts allow."""

    def of(keys: list[str], name: str) -> DataFrame:
        part = W.partitionBy(*keys, "rule")
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        cum = merged.select(
            *keys, "rule", "bucket", F.sum("n").over(part.orderBy("bucket")).alias("upto"), F.sum("n").over(part).alias("all")
        )
        q = cum.groupBy(*keys, "rule").agg(
            F.max("all").alias("all"),
            F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("b1"),
            F.min(F.when(F.col("upto") * 4 >= 3 * F.col("all"), F.col("bucket"))).alias("b3"),
        )
        spread = F.create_map(*[x for k, r in RULES.items() for x in (F.lit(k), F.lit(r[2]).cast("long"))])[F.col("rule")]
        fence = _edge(F.col("b3")) + REACH * F.greatest(_edge(F.col("b3")) - _edge(F.col("b1")), spread)
        return q.select(*keys, "rule", F.struct("all", fence.alias("fence")).alias(name))

    fine, mid, top = of(["lang", "source"], "f"), of(["lang"], "m").withColumnRenamed("lang", "l2"), of([], "t")
    joined = (
        fine.join(mid.withColumnRenamed("rule", "r2"), F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rule") == F.col("r2")))
        .join(top.withColumnRenamed("rule", "r3"), F.col("rule") == F.col("r3"))
    )
    enough = lambda c: F.col(f"{c}.all") >= LEAST_DOCUMENTS
    chosen = F.when(enough("f"), F.col("f.fence")).when(enough("m"), F.col("m.fence")).otherwise(F.col("t.fence"))
    return joined.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == k, chosen)).alias(f"max_{k}") for k in RULES]
    )


def judged(metrics: DataFrame) -> DataFrame:
    """Add `base_failed` and `kept`. `metrics` is read twice, so it should be a stored table.

    A document is kept if the base rules pass and no value exceeds the fence of its (lang, source); null languages and
    sources are groups of their own.
    """
    limits = stored(fences(sketches(metrics)), "fences").select(
        F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[f"max_{k}" for k in RULES]
    )
    joined = metrics.join(
        limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left"
    )
    within = F.lit(True)
    for k, v in values().items():
        within = within & F.coalesce(v <= F.col(f"max_{k}"), F.lit(True))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & within}).drop(*limits.columns)


def assess(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang, source): doc_id, the five base metrics, base_failed and kept.

    Null or blank text: no words, base_failed. Repeated rows are judged alike. An empty table gives an empty result.
    """
    metrics = measured(docs, F.col("text"), [F.col("doc_id"), F.col("lang"), F.col("source")])
    return judged(stored(metrics, "quality")).select("doc_id", *METRICS, "base_failed", "kept")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with all their columns; extra columns of any name are carried through.

    Rows with a null or blank text go; repeated rows stay or go together, and an empty table gives an empty result.
    """
    row = boxed(docs)
    metrics = measured(row, F.col("row.text"), [F.col("row"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source")])
    return unboxed(judged(stored(metrics, "quality")).where("kept"), docs.columns)
