"""Exact linear quantiles per key without gathering a group in one task.

Up to `direct_rows` rows per key the built-in `percentile` (with map-side
combine) is exact and cheap. Above that, a mergeable sketch brackets every wanted
rank, one pass counts what lies below the bracket, and only the rows inside it are
ordered; a bracket that is still large is narrowed again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import checkpointed, maybe_broadcast, values_frame

DIRECT_ROWS = 2_000_000
SMALL_ROWS = 50_000
MEDIUM_FACTOR = 10
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Rows (keys..., q0, q1, ...) with q_i the linear quantile of `value` at probs[i]."""
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    sizes = data.groupBy(*keys).agg(F.count("*").alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    if largest <= direct_rows:
        return _direct(data, keys, probs)
    if not keys:
        return _by_brackets(data, keys, probs, direct_rows)
    hot = maybe_broadcast(sizes.where(F.col("__n") > direct_rows).select(*[F.col(k).alias(f"__h_{k}") for k in keys]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
    return _direct(data.join(hot, same, "left_anti"), keys, probs).unionByName(
        _by_brackets(data.join(hot, same, "left_semi"), keys, probs, direct_rows))


def _direct(data: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    exprs = [F.expr(f"percentile(__v, {p!r}D)").alias(f"q{i}") for i, p in enumerate(probs)]
    return data.groupBy(*keys).agg(*exprs)


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], direct_rows: int = DIRECT_ROWS,
                     small_rows: int = SMALL_ROWS):
    """{column: [quantiles]} collected as fitted parameters (columns x probs numbers).

    Small tables use `percentile`, which keeps every distinct value in a slow map. Others are read twice: a sketch brackets
    each rank, then only the values inside the bracket are counted. Medium tables send those (about half a percent of the
    rows) to the driver. Larger ones keep them as a table, which is bracketed again where it still holds many values.
    """
    if not columns:
        return {}
    rows = df.agg(F.count("*")).first()[0]
    if rows <= small_rows:
        return _direct_columns(df, columns, probs)
    return _by_probes(df, columns, probs, direct_rows, rows <= direct_rows * MEDIUM_FACTOR)


def _direct_columns(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list]:
    # one branch per column: each scans its own column, and the branches run side by side
    grid = F.array(*[F.lit(float(p)) for p in probs])
    parts = [df.agg(F.percentile(F.col(c).cast("double"), grid).alias("q")).select(F.lit(c).alias("column"), "q") for c in columns]
    got = {r["column"]: r["q"] for r in reduce(DataFrame.unionByName, parts).collect()}
    return {c: (got[c] or [None] * len(probs)) for c in columns}


def _by_probes(df: DataFrame, columns: list[str], probs: list[float], limit: int, medium: bool) -> dict[str, list]:
    accuracy = 1000 if medium else ACCURACY
    margin = 2.5 / accuracy
    grid = [min(max(q, 0.0), 1.0) for p in probs for q in (p - margin, p + margin)]
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(df.agg(F.percentile_approx(x, F.array(*[F.lit(g) for g in grid]), accuracy).alias("cuts"), F.count(x).alias("n"),
                            F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.lit(c).alias("column"), "cuts", "n", "lo", "hi"))
    marks = {r["column"]: r for r in reduce(DataFrame.unionByName, parts).collect()}
    parts = []
    for c in columns:
        m, x = marks[c], F.col(c).cast("double")
        if not m["n"]:
            continue
        for i, p in enumerate(probs):
            lo = m["lo"] if p <= margin else m["cuts"][2 * i]
            hi = m["hi"] if p >= 1 - margin else m["cuts"][2 * i + 1]
            # values in the bracket keep their count, all smaller ones share the NULL group
            counts = df.where(x <= hi).groupBy(F.when(x >= lo, x).alias("x")).agg(F.count("*").alias("k"))
            parts.append(counts.select(F.lit(c).alias("column"), F.lit(i).alias("i"), "x", "k"))
    if not parts:
        return {c: [None] * len(probs) for c in columns}
    inside = reduce(DataFrame.unionByName, parts)
    below = {}
    if not medium:
        ranks = {(c, i): (marks[c]["n"] - 1) * p for c in columns if marks[c]["n"] for i, p in enumerate(probs)}
        inside, below = _few_values(inside, ranks, limit)
    held = {}
    for r in inside.collect():
        if r["x"] is None:
            below[r["column"], r["i"]] = below.get((r["column"], r["i"]), 0) + r["k"]
        else:
            held.setdefault((r["column"], r["i"]), []).append((r["x"], r["k"]))
    out, missed = {}, set()
    for c in columns:
        got = []
        for i, p in enumerate(probs):
            if not marks[c]["n"]:
                got.append(None)
                continue
            value = _pick(held.get((c, i), []), below.get((c, i), 0), (marks[c]["n"] - 1) * p)
            if value is None:
                missed.add(c)  # the sketch was off; look at this column in full
            got.append(value)
        out[c] = got
    if missed and medium:
        out.update(_direct_columns(df, sorted(missed), probs))
    elif missed:
        table = exact_quantiles(long_numeric(df, sorted(missed)), ["column"], "value", probs, limit)
        out.update({r["column"]: [r[f"q{i}"] for i in range(len(probs))] for r in table.collect()})
    return out


def _few_values(counts: DataFrame, ranks: dict[tuple[str, int], float], limit: int, cells: int = 1000) -> tuple[DataFrame, dict[tuple[str, int], int]]:
    """The rows (column, i, x, k) of `counts` that the fractional ranks can lie on, and how many values were left out below them.

    While a bracket has more than a hundredth of `limit` different values, its span is cut into `cells` equal cells, and only those of
    the wanted ranks are kept. A bracket that does not shrink so, or has no finite span, is left out as a whole.
    """
    counts = checkpointed(counts)
    below: dict[tuple[str, int], int] = {}
    before: dict[tuple[str, int], int] = {}
    while True:
        known = counts.where("x is not null").groupBy("column", "i").agg(F.count("*").alias("values"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        wide = [r for r in known.collect() if r["values"] > limit // 100 and r["lo"] < r["hi"]]
        if not wide:
            return counts, below
        spans = values_frame(counts.sparkSession, [(r["column"], r["i"], r["lo"], (r["hi"] - r["lo"]) / cells) for r in wide],
                             "column string, i int, lo double, step double")
        placed = counts.join(F.broadcast(spans), ["column", "i"], "left")
        placed = placed.withColumn("cell", F.floor((F.col("x") - F.col("lo")) / F.col("step")))
        sums = placed.where("step is not null").groupBy("column", "i", "cell").agg(F.sum("k").alias("k")).collect()
        kept = []
        for r in wide:
            key = (r["column"], r["i"])
            cut = sorted(((s["cell"], s["k"]) for s in sums if (s["column"], s["i"]) == key), key=lambda s: -1 if s[0] is None else s[0])
            upto, least, most, under = below.get(key, 0), None, None, 0
            for cell, k in cut:
                if cell is not None and least is None and upto + k > int(ranks[key]):
                    least, under = cell, upto
                if cell is not None and upto < ranks[key] + 1:
                    most = cell
                upto += k
            step = (r["hi"] - r["lo"]) / cells
            if least is None or not 0 < step < math.inf or r["values"] == before.get(key):
                least, most, under = 0, -1, 0
            before[key] = r["values"]
            kept.append((*key, least, most))
            below[key] = under
        bounds = values_frame(counts.sparkSession, kept, "column string, i int, least long, most long")
        placed = placed.join(F.broadcast(bounds), ["column", "i"], "left")
        counts = checkpointed(placed.where("least is null or cell between least and most").select("column", "i", "x", "k"))


def _pick(values: list[tuple[float, int]], below: int, position: float) -> float | None:
    """Linear quantile at a fractional rank, or None if the values do not cover it."""
    lo, hi = int(position), int(position) + (position > int(position))
    a = b = None
    upto = below
    for x, k in sorted(values):
        if a is None and upto <= lo < upto + k:
            a = x
        if upto <= hi < upto + k:
            b = x
            break
        upto += k
    if a is None or b is None:
        return None
    return a if a == b else a * (hi - position) + b * (position - lo)


def long_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) pairs of the numeric columns, one scan."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, value)")


def _by_brackets(data: DataFrame, keys: list[str], probs: list[float], limit: int) -> DataFrame:
    # one task per wanted rank: a linear quantile needs the two order statistics around it
    base = data.groupBy(*keys).agg(F.count("*").alias("__n"))
    position = {i: (F.col("__n") - 1) * F.lit(float(p)) for i, p in enumerate(probs)}
    wanted = F.array(*[
        F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"),
                 (F.floor(pos) if side == 0 else F.ceil(pos)).cast("bigint").alias("rank"))
        for i, pos in position.items() for side in (0, 1)
    ])
    ranks = base.select(*keys, "__n", F.explode(wanted).alias("w")).select(*keys, "__n", "w.*")
    ranks = ranks.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "below": F.lit(0).cast("bigint")})
    ranks = ranks.withColumn("inside", F.col("__n"))
    ranks = checkpointed(ranks)
    widest = F.max(F.when(F.col("lo") < F.col("hi"), F.col("inside")))
    size, before = ranks.agg(widest).first()[0] or 0, None
    while size > limit and size != before:
        ranks = checkpointed(_narrow(data, ranks, keys))
        size, before = ranks.agg(widest).first()[0] or 0, size
    inside = _within(data, ranks, keys).groupBy(*keys, "q", "side", "rank", "below", "__n", "__v").agg(
        F.count("*").alias("__c"))
    w = Window.partitionBy(*keys, "q", "side").orderBy("__v")
    hit = (
        inside.withColumn("upto", F.col("below") + F.sum("__c").over(w))
        .where(F.col("upto") > F.col("rank"))
        .groupBy(*keys, "q", "side").agg(F.min("__v").alias("x"), F.first("__n").alias("__n"))
    )
    both = hit.groupBy(*keys, "q").agg(
        F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b"),
        F.first("__n").alias("__n"),
    )
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("q") + 1)
    pos = (F.col("__n") - 1) * prob
    mixed = F.col("a") * (F.ceil(pos) - pos) + F.col("b") * (pos - F.floor(pos))
    out = both.withColumn("r", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(mixed))
    picks = [F.max(F.when(F.col("q") == i, F.col("r"))).alias(f"q{i}") for i in range(len(probs))]
    return out.groupBy(*keys).agg(*picks)


def _within(data: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `data` paired with each bracket of their key that contains them."""
    side = maybe_broadcast(ranks.withColumnsRenamed({k: f"__w_{k}" for k in keys}))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__w_{k}")) for k in keys], F.lit(True))
    inside = (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))
    return data.join(side, same & inside).drop(*[f"__w_{k}" for k in keys])


def _narrow(data: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Shrink each bracket around its rank by a factor of about ACCURACY / 4."""
    inside = _within(data, ranks.where(F.col("lo") < F.col("hi")), keys)
    group = [*keys, "q", "side"]
    share = (F.col("rank") - F.col("below")) / F.col("inside")
    # percentages must be constants for the sketch, so take a fine fixed grid and look up around the share
    steps = 1000
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    sketch = inside.groupBy(*group).agg(F.percentile_approx("__v", grid, ACCURACY).alias("cuts"))
    cell = F.floor(share * steps).cast("int")
    picked = (
        ranks.join(sketch, [*group], "left")
        .withColumn("new_lo", F.coalesce(F.element_at("cuts", F.greatest(cell - 1, F.lit(0)) + 1), F.col("lo")))
        .withColumn("new_hi", F.coalesce(F.element_at("cuts", F.least(cell + 3, F.lit(steps)) + 1), F.col("hi")))
        .drop("cuts")
    )
    picked = picked.withColumns({
        "new_lo": F.when(cell <= 1, F.col("lo")).otherwise(F.col("new_lo")),
        "new_hi": F.when(cell >= steps - 3, F.col("hi")).otherwise(F.col("new_hi")),
    })
    probe = _within(data, picked, keys).groupBy(*group).agg(
        F.count_if(F.col("__v") < F.col("new_lo")).alias("under"),
        F.count_if((F.col("__v") >= F.col("new_lo")) & (F.col("__v") <= F.col("new_hi"))).alias("kept"),
        F.min(F.when(F.col("__v") >= F.col("new_lo"), F.col("__v"))).alias("vmin"),
        F.max(F.when(F.col("__v") <= F.col("new_hi"), F.col("__v"))).alias("vmax"),
    )
    moved = picked.join(probe, [*group], "left")
    ok = (F.col("rank") >= F.col("below") + F.col("under")) & (
        F.col("rank") < F.col("below") + F.col("under") + F.col("kept"))
    # a sketch outside its error bound keeps the old bracket: still exact, only more rows to order
    return moved.select(
        *keys, "__n", "q", "side", "rank",
        F.when(ok, F.col("vmin")).otherwise(F.col("lo")).alias("lo"),
        F.when(ok, F.col("vmax")).otherwise(F.col("hi")).alias("hi"),
        F.when(ok, F.col("below") + F.col("under")).otherwise(F.col("below")).alias("below"),
        F.when(ok, F.col("kept")).otherwise(F.col("inside")).alias("inside"),
    )
