"""Least squares per key from summed cross products.

Tasks send one matrix of sums per key and batch; these are added up per cell. However
long a series is, no task ever needs it whole, and the solve sees one small matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_products(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """(keys..., m, cells): sums of products of the entries of the array column `row`; rows with a NULL entry are skipped.

    `cells` is the row-major m x m matrix.
    """
    usable = df.where(~F.exists(row, lambda v: v.isNull() | F.isnan(v)))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    schema = f"{key_schema}, m int, cells array<double>" if keys else "m int, cells array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            out = []
            groups = b.groupby(keys, dropna=False, sort=False) if keys else [((), b)]
            for key, g in groups:
                x = np.array(g[row].tolist(), dtype=float)
                key = key if isinstance(key, tuple) else (key,)
                out.append((*key, x.shape[1], (x.T @ x).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*keys, "m", "cells"])

    parts = usable.select(*keys, row).mapInPandas(partial, schema)
    cells = parts.select(*keys, "m", F.posexplode("cells").alias("i", "x"))
    summed = cells.groupBy(*keys, "m", "i").agg(F.sum("x").alias("x"))
    return summed.groupBy(*keys, "m").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("cells"))


def solve_each(grams: DataFrame, keys: list[str], solve: Callable[[np.ndarray, dict], list[dict]], columns: str) -> DataFrame:
    """Apply `solve(matrix, row)` to every key's matrix; it returns rows of `columns`."""
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema.fields if f.name in keys)
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                g = np.asarray(r["cells"], dtype=float).reshape(int(r["m"]), int(r["m"]))
                for s in solve(g, r):
                    out.append((*[r[k] for k in keys], *[s[n] for n in names]))
            yield pd.DataFrame(out, columns=[*keys, *names])

    return grams.mapInPandas(run, ", ".join(x for x in (key_schema, columns) if x))


def ols(g: np.ndarray, use: list[int], ridge: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, residual sum, inverse) of the last entry on the entries `use`."""
    a, b = g[np.ix_(use, use)], g[use, -1]
    a = a + (np.diag(ridge) if ridge is not None else 0)
    # columns brought to one scale, so that only true collinearity is cut off
    d = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    inv = np.linalg.pinv(a * d[:, None] * d[None, :], rcond=1e-12, hermitian=True) * d[:, None] * d[None, :]
    coef = inv @ b
    rss = g[-1, -1] - 2 * coef @ b + coef @ g[np.ix_(use, use)] @ coef
    return coef, max(float(rss), 1e-300), inv
