"""Row-order operators per key that hold when one key owns a large share of the rows.

A plain window sends a key to one task. Every function here first checks the
largest key. Small keys use the plain window. Otherwise the rows are range
partitioned by (key, order), which cuts a hot key into many partitions, get exact
positions from per-partition counts, and are processed in chunks of positions that
carry just the neighbouring rows a frame can reach.

`order` must identify a row within its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import checkpointed, maybe_broadcast

MAX_ROWS = 2_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    if not keys:
        return df.agg(F.count("*")).first()[0]
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _over(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)


def row_positions(
    df: DataFrame, keys: list[str], order: list[str], name: str = "pos", max_rows: int = MAX_ROWS
) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    if largest_group(df, keys) <= max_rows:
        return df.withColumn(name, (F.row_number().over(_over(keys, order)) - 1).cast("bigint"))
    return _spread_positions(df, keys, order, name)


def _spread_positions(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    cut = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # within a sorted partition the id counts up by one, so it orders the whole table
    marked = checkpointed(cut.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    marked = marked.withColumn("__part", part)
    spans = marked.groupBy(*keys, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    joined = _join_keys(marked, maybe_broadcast(spans), [*keys, "__part"])
    return joined.withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop(
        "__id", "__part", "__first", "__before")


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join where NULL keys meet; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def framed(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: int,
    after: int,
    build: Callable[[Window], dict[str, Column]],
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add the window columns `build(window)`, whose frames reach at most
    `before` rows back and `after` rows ahead."""
    if largest_group(df, keys) <= max_rows:
        return df.withColumns(build(_over(keys, order)))
    size = max(max_rows, before, after, 1)
    placed = _spread_positions(df, keys, order, "__pos")
    home = F.floor(F.col("__pos") / size)
    place = F.col("__pos") % size
    chunks = F.array_compact(F.array(
        home, F.when(place >= size - before, home + 1), F.when((place < after) & (home > 0), home - 1)))
    copies = placed.withColumn("__home", home).withColumn("__chunk", F.explode(chunks))
    w = Window.partitionBy(*keys, "__chunk").orderBy("__pos")
    done = copies.withColumns(build(w)).where(F.col("__home") == F.col("__chunk"))
    return done.drop("__pos", "__home", "__chunk")


def carried(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    forward: bool = True,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add, per output name, the nearest non-null value at or before the row
    (`forward`) or at or after it."""
    # looking ahead is looking back in reverse order: a frame open at its far end costs a rescan per row
    side = F.asc if forward else F.desc
    if largest_group(df, keys) <= max_rows:
        w = _over(keys, [side(c) for c in order])
        return df.withColumns({n: _nearest(v, w) for n, v in values.items()})
    placed = _spread_positions(df, keys, order, "__pos").withColumn("__chunk", F.floor(F.col("__pos") / max_rows))
    temps = {f"__c_{n}": v for n, v in values.items()}
    placed = placed.withColumns(temps)
    local = Window.partitionBy(*keys, "__chunk").orderBy(side("__pos"))
    filled = placed.withColumns({f"__l_{n}": _nearest(F.col(f"__c_{n}"), local) for n in values})
    pick = F.max_by if forward else F.min_by
    ends = placed.groupBy(*keys, "__chunk").agg(*[
        pick(F.col(f"__c_{n}"), F.when(F.col(f"__c_{n}").isNotNull(), F.col("__pos"))).alias(f"__e_{n}")
        for n in values
    ])
    frame = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(side("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__chunk", *[
        F.last(f"__e_{n}", ignorenulls=True).over(frame).alias(f"__p_{n}") for n in values])
    joined = _join_keys(filled, maybe_broadcast(ends), [*keys, "__chunk"], "left")
    out = joined.withColumns({n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__p_{n}")) for n in values})
    drop = [f"__{t}_{n}" for n in values for t in "clp"]
    return out.drop("__pos", "__chunk", *drop)


def _nearest(value: Column, w: Window) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], max_rows: int = MAX_ROWS
) -> DataFrame:
    """Add inclusive running sums in row order."""
    if largest_group(df, keys) <= max_rows:
        w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(v).over(w) for n, v in sums.items()})
    placed = _spread_positions(df, keys, order, "__pos").withColumn("__chunk", F.floor(F.col("__pos") / max_rows))
    placed = placed.withColumns({f"__s_{n}": v for n, v in sums.items()})
    local = Window.partitionBy(*keys, "__chunk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(*keys, "__chunk").agg(*[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums])
    chain = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__chunk", *[
        F.coalesce(F.sum(f"__t_{n}").over(chain), F.lit(0)).alias(f"__b_{n}") for n in sums])
    joined = _join_keys(placed, maybe_broadcast(totals), [*keys, "__chunk"])
    out = joined.withColumns({n: F.col(f"__b_{n}") + F.sum(f"__s_{n}").over(local) for n in sums})
    return out.drop("__pos", "__chunk", *[f"__{t}_{n}" for n in sums for t in "sb"])


def hash_ranks(df: DataFrame, keys: list[str], key_hash: str, name: str = "rank", max_rows: int = MAX_ROWS) -> DataFrame:
    """Add the 0-based rank of a row among its key by an evenly spread hex hash.

    The first hex digits cut every key, hot or not, into even cells; ranks are a
    cell offset plus the rank inside the cell, so no key goes to one task.
    Equal hashes are ordered arbitrarily but counted once each.
    """
    largest = largest_group(df, keys)
    digits = 0
    while largest > max_rows * (16 ** digits) and digits < 8:
        digits += 1
    if digits == 0:
        return df.withColumn(name, (F.row_number().over(_over(keys, [key_hash])) - 1).cast("bigint"))
    cells = df.withColumn("__cell", F.substring(key_hash, 1, digits))
    w = Window.partitionBy(*keys, "__cell").orderBy(key_hash)
    chain = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    offsets = offsets.select(*keys, "__cell", F.coalesce(F.sum("__n").over(chain), F.lit(0)).alias("__off"))
    ranked = cells.withColumn("__in", F.row_number().over(w) - 1)
    joined = _join_keys(ranked, maybe_broadcast(offsets), [*keys, "__cell"])
    return joined.withColumn(name, (F.col("__off") + F.col("__in")).cast("bigint")).drop("__cell", "__in", "__off")
