"""Mixing sources to target weights by hierarchical token budgets (DataFrame functions only).

The tree is domain, language, source. A node's capacity is the sum of its leaves' tokens times the allowed epochs. A
budget flows down in proportion to the weights; a child that cannot use its share gets its capacity, and the rest is
spread over its siblings first. As a node never receives more than its capacity, only what a whole subtree cannot use
reaches the level above. Sorted by capacity over weight, the saturated children are a prefix, which gives each level a
closed form over a few window sums.

A leaf's budget is used in epochs: whole passes first, then a token-prefix of the leaf in an order seeded by leaf-independent
hashes of that epoch. The end of the prefix is found by radix descent over hash digits: sums per (leaf, digit) pick
the digit in which the budget ends, then the next digit inside it, so that rows are only ordered within one small cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.llm.base import boxed, stored, unboxed, words

#: Target weights by level; anything not named has weight DEFAULT. Siblings are weighed against each other.
DOMAINS = {"web": 6.0, "books": 3.0, "code": 1.0}
LANGUAGES = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 2.0}
DEFAULT = 1.0
#: The budget as a share of all tokens, and the most passes over a leaf.
SHARE = 0.75
EPOCHS = 2
SEED = "mix-1"
LEVELS = ["domain", "lang", "source"]
#: Hex digits of a radix step, and how many steps before rows are ordered.
DIGITS, STEPS = 2, 2


def domain_of(source: Column) -> Column:
    """Domain of a source by its trailing number: 0, 3, 6... web, 1, 4, 7... books, others code; none: web."""
    n = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 3
    return F.when(n == 0, "web").when(n == 1, "books").otherwise("code")


def _weight(level: str) -> Column:
    named = {"domain": DOMAINS, "lang": LANGUAGES}.get(level)
    if not named:
        return F.lit(DEFAULT)
    out = F.lit(DEFAULT)
    for k, v in named.items():
        out = F.when(F.col(level) == k, F.lit(v)).otherwise(out)
    return out


def _poured(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Split each parent's `budget` over its children (columns capacity and weight)."""
    group = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    fill = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = group.orderBy("fill", level)
    nodes = nodes.withColumn("fill", fill)
    nodes = nodes.select(
        "*",
        F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("used"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open"),
    )
    nodes = nodes.withColumn("full", F.col("capacity") * F.col("open") <= F.col("weight") * (F.col("budget") - F.col("used")))
    rest = F.max(F.when(~F.col("full"), F.struct((-F.col("used")).alias("a"), F.col("open").alias("w")))).over(group)
    nodes = nodes.withColumn("rest", rest)
    share = F.col("weight") * (F.col("budget") + F.col("rest.a")) / F.col("rest.w")
    got = F.when(F.col("full"), F.col("capacity")).otherwise(F.coalesce(share, F.lit(0.0)))
    return nodes.withColumn("got", got).drop("fill", "used", "open", "full", "rest")


def budgets(leaves: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens): whole tokens for every leaf."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    total = leaves.agg(F.coalesce(F.least(F.sum("tokens") * F.lit(share), F.sum("cap")), F.lit(0.0)).alias("budget"))
    above = total
    for depth, level in enumerate(LEVELS):
        parents, keys = LEVELS[:depth], LEVELS[: depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("capacity")).withColumn("weight", _weight(level))
        if parents:
            renamed = above.select(*[F.col(p).alias(f"_{p}") for p in parents], "budget")
            on = F.lit(True)
            for p in parents:
                on = on & F.col(p).eqNullSafe(F.col(f"_{p}"))
            nodes = nodes.join(renamed, on).drop(*[f"_{p}" for p in parents])
        else:
            nodes = nodes.join(F.broadcast(above))  # a global aggregate: one row
        above = _poured(nodes, parents, level).select(*keys, F.col("got").alias("budget"))
    out = above.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], F.floor(F.col("budget") + F.lit(1e-6)).cast("long").alias("budget"))
    on = F.lit(True)
    for k in LEVELS:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return leaves.join(out, on).select(*LEVELS, "tokens", "budget")


def _matches(plan: DataFrame) -> Column:
    on = F.lit(True)
    for k in LEVELS:
        on = on & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    return on


def planned(items: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per leaf: p_domain, p_lang, p_source, budget, passes (whole epochs) and cut.

    In epoch `passes` the documents with `order <= cut` are taken too; cut is null if none is. `items` has domain, lang,
    source, n_tokens and ident, and should be a stored table.
    """
    leaves = items.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    b = budgets(leaves, share, epochs)
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(0).cast("int")
    plan = b.select(*[F.col(k).alias(f"p_{k}") for k in LEVELS], "tokens", "budget", passes.alias("passes"))
    plan = plan.withColumn("left", F.col("budget") - F.col("passes") * F.col("tokens")).withColumn("prefix", F.lit(""))
    plan = stored(plan, "leaves")
    base = plan
    mine = W.partitionBy(*[f"p_{k}" for k in LEVELS])
    for step in range(STEPS):
        rows = items.join(plan, _matches(plan)).withColumn("order", order_key())
        inside = rows.where(F.col("order").startswith(F.col("prefix")))
        cells = inside.groupBy(*plan.columns, F.substring("order", 1, DIGITS * (step + 1)).alias("cell")).agg(
            F.sum("n_tokens").alias("n")
        )
        cum = cells.withColumn("upto", F.sum("n").over(mine.orderBy("cell")))
        first = F.min(F.when(F.col("upto") > F.col("left"), F.struct("cell", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))))
        plan = stored(
            cum.groupBy(*[f"p_{k}" for k in LEVELS]).agg(first.alias("x"))
            .where("x is not null").select(*[f"p_{k}" for k in LEVELS], F.col("x.cell").alias("prefix"), F.col("x.left").alias("left")),
            "cells",
        )
        plan = plan.join(base.select(*[F.col(f"p_{k}").alias(f"b_{k}") for k in LEVELS], "passes"), _same("p_", "b_")).drop(
            *[f"b_{k}" for k in LEVELS]
        )
    rows = items.join(plan, _matches(plan)).withColumn("order", order_key()).where(F.col("order").startswith(F.col("prefix")))
    run = rows.withColumn("upto", F.sum("n_tokens").over(mine.orderBy("order").rangeBetween(W.unboundedPreceding, 0)))
    ends = run.groupBy(*[f"p_{k}" for k in LEVELS], "prefix").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("order"))).alias("last"))
    # documents of earlier cells sort before the prefix itself, so the prefix is the cut when none inside fits
    cuts = ends.select(*[F.col(f"p_{k}").alias(f"b_{k}") for k in LEVELS], F.coalesce("last", "prefix").alias("cut"))
    # a leaf without tokens costs nothing: it is taken as a whole, by a cut above every hexadecimal key
    cut = F.when(F.col("tokens") == 0, F.lit("g")).otherwise(F.col("cut")).alias("cut")
    return stored(base.join(cuts, _same("p_", "b_"), "left").select(*[f"p_{k}" for k in LEVELS], "budget", "passes", cut), "mix")


def _same(a: str, b: str) -> Column:
    on = F.lit(True)
    for k in LEVELS:
        on = on & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}"))
    return on


def order_key() -> Column:
    """Place of a document in its leaf's unfinished epoch: the seed, the epoch and the document decide."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.col("passes").cast("string"), F.col("ident")).cast("binary"))


def _items(df: DataFrame, doc_id: Column, text: Column, lang: Column, source: Column, more: list[Column]) -> DataFrame:
    """One row per document; documents of equal id and text share an `ident` and are taken or left together."""
    ident = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return df.select(
        *more, domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"),
        F.size(words(text)).cast("long").alias("n_tokens"), ident.alias("ident"),
    )


def _copies() -> Column:
    return (F.col("passes") + F.coalesce(F.col("order") <= F.col("cut"), F.lit(False)).cast("int")).cast("int")


def mixed(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per row of `docs`: doc_id, domain, lang, source, n_tokens, leaf_budget and copies (epochs that take it, 0 if none).

    Tokens are words. Null texts have none; null languages and sources are leaves of their own. An empty table gives an
    empty result.
    """
    items = stored(_items(docs, F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), [F.col("doc_id")]), "items")
    plan = planned(items, share, epochs)
    rows = items.join(plan, _matches(plan), "left").withColumn("order", order_key())
    return rows.select("doc_id", "domain", "lang", "source", "n_tokens", F.col("budget").alias("leaf_budget"), _copies().alias("copies"))


def sampled(docs: DataFrame, share: float = SHARE, epochs: int = 1) -> DataFrame:
    """The chosen rows of `docs` with all their columns, repeated once for each epoch that takes them.

    Null texts have no tokens; null languages and sources are leaves of their own. Rows equal in id and text are taken
    together, and an empty table gives an empty result.
    """
    row = boxed(docs)
    def items() -> DataFrame:
        return _items(row, F.col("row.doc_id"), F.col("row.text"), F.col("row.lang"), F.col("row.source"), [F.col("row")])

    plan = planned(stored(items().drop("row"), "items"), share, epochs)
    rows = items().join(plan, _matches(plan), "left").withColumn("order", order_key())
    taken = rows.withColumn("copies", _copies()).where("copies > 0")
    if epochs > 1:
        taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unboxed(taken, docs.columns)
