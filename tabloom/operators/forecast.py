"""Forecasting many series at once, fitted from summed cross products.

Input: regular series (keys..., time, y) with a distinct time per series. Lags go
through skew-safe windows and fits through `functions.gram`, so one very long series
costs no more memory in a task than many short ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.cells import is_numeric
from tabloom.functions.gram import cross_products, ols, solve_each
from tabloom.functions.ordering import framed
from tabloom.operators import evaluate
from tabloom.session import checkpointed, maybe_broadcast

MAX_P, MAX_Q, MAX_D = 5, 5, 2
LONG_AR = 12
# 5 % critical value of the unit-root test with a constant (MacKinnon).
ADF_5_PERCENT = -2.86154


def _beside_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls included; `b` has one row per key."""
    b = b.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return a.join(b, on, how).drop(*[f"__key_{k}" for k in keys])


def _lags(w, column: str, upto: int) -> list[Column]:
    return [F.lag(column, k).over(w) for k in range(1, upto + 1)]


# ---- unit roots ----

def adf_order(df: DataFrame, keys: list[str], time: str, y: str, max_d: int = MAX_D) -> DataFrame:
    """(keys..., d, stat0.., lag0..): smallest d whose lag-d difference has no unit root, else max_d.

    The lag length is chosen by AIC from 0 up to the usual length for the series' own row count; lags beyond it are set
    to zero, so that they cost the series no rows. A series too short for any statistic keeps order 0.
    """
    sizes = checkpointed(df.groupBy(*keys).agg(F.count("*").alias("__n"))).withColumn(
        "__longest", F.greatest(F.lit(1), F.floor(12 * F.pow(F.col("__n") / 100, F.lit(0.25)))).cast("int"))
    longest = sizes.agg(F.max("__longest")).first()[0] or 1
    df = _beside_keys(df, maybe_broadcast(sizes.drop("__n")), keys)
    out = sizes.select(*keys)
    for d in range(max_d + 1):
        if d:
            base = framed(df, keys, [time], d, 0, lambda w, d=d: {"__x": F.col(y) - F.lag(y, d).over(w)}).where(F.col("__x").isNotNull())
        else:
            base = df.where(F.col(y).isNotNull()).withColumn("__x", F.col(y).cast("double"))
        wide = framed(base, keys, [time], longest + 1, 0, lambda w: {
            "__row": F.array(F.lit(1.0), F.lag("__x", 1).over(w), *[
                F.when(F.col("__longest") < k, 0.0).otherwise(F.lag("__x", k).over(w) - F.lag("__x", k + 1).over(w))
                for k in range(1, longest + 1)],
                F.col("__x") - F.lag("__x", 1).over(w))})
        stats = solve_each(cross_products(wide, keys, "__row"), keys, _adf_stat, "stat double, lag int")
        stats = stats.select(*keys, F.col("stat").alias(f"stat{d}"), F.col("lag").alias(f"lag{d}"))
        out = _beside_keys(out, stats, keys, "left")
    rule = F.lit(None)
    for d in range(max_d + 1):
        rule = F.when(F.col("stat0").isNull() | (F.col("stat0") < ADF_5_PERCENT), 0) if d == 0 else rule.when(F.col(f"stat{d}") < ADF_5_PERCENT, d)
    return out.withColumn("d", rule.otherwise(max_d))


def _adf_stat(g: np.ndarray, row: dict) -> list[dict]:
    n = g[0, 0]
    used = int(np.count_nonzero(np.diag(g)[2:-1]))  # lags beyond the series' own length are all zero
    longest = min(used, max(0, int(12 * (n / 100) ** 0.25)), max(0, int(n) // 2 - 4))
    best = None
    for lag in range(longest + 1):
        use = list(range(2 + lag))
        coef, rss, inv = ols(g, use)
        aic = n * math.log(rss / n) + 2 * len(use)
        if best is None or aic < best[0]:
            spread = math.sqrt(max(rss / max(n - len(use), 1) * inv[1, 1], 1e-300))
            best = (aic, coef[1] / spread, lag)
    return [{"stat": float(best[1]), "lag": int(best[2])}]


# ---- ARIMA by two regressions (Hannan and Rissanen) ----

def difference(df: DataFrame, keys: list[str], time: str, y: str, orders: DataFrame | None, d: int = 0) -> DataFrame:
    """Add `d` and `z`, the order-d difference of y (d up to 2, per series from `orders` or fixed)."""
    wide = framed(df.where(F.col(y).isNotNull()), keys, [time], 2, 0, lambda w: {
        "__1": F.col(y) - F.lag(y, 1).over(w), "__2": F.col(y) - 2 * F.lag(y, 1).over(w) + F.lag(y, 2).over(w)})
    wide = wide.join(maybe_broadcast(orders.select(*keys, "d")), keys) if orders is not None else wide.withColumn("d", F.lit(d))
    z = F.when(F.col("d") == 0, F.col(y).cast("double")).when(F.col("d") == 1, F.col("__1")).otherwise(F.col("__2"))
    return wide.withColumn("z", z).drop("__1", "__2").where(F.col("z").isNotNull())


def with_innovations(z: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Add `e`, the residual of an autoregression of z over LONG_AR lags, or a third of the rows of a shorter series."""
    sizes = checkpointed(z.groupBy(*keys).agg(F.greatest(F.lit(1), F.least(F.lit(LONG_AR), F.floor(F.count("*") / 3))).cast("int").alias("__reach")))
    z = z.join(maybe_broadcast(sizes), keys)
    wide = framed(z, keys, [time], LONG_AR, 0, lambda w: {"__lags": F.array(F.lit(1.0), *[
        F.when(F.col("__reach") < k, 0.0).otherwise(lag.cast("double")) for k, lag in enumerate(_lags(w, "z", LONG_AR), 1)])})
    wide = wide.drop("__reach")
    rows = wide.withColumn("__row", F.concat("__lags", F.array("z")))

    def solve(g: np.ndarray, row: dict) -> list[dict]:
        use = [i for i in range(len(g) - 1) if g[i, i] > 0]
        ar = np.zeros(len(g) - 1)
        ar[use] = ols(g, use)[0]
        return [{"ar": ar.tolist()}]

    fits = solve_each(cross_products(rows, keys, "__row"), keys, solve, "ar array<double>")
    joined = wide.join(maybe_broadcast(fits), keys)
    fit = F.aggregate(F.zip_with("__lags", "ar", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.withColumn("e", F.col("z") - fit).drop("__lags", "ar")


def arima_candidates(df: DataFrame, keys: list[str], time: str, y: str, orders: DataFrame | None = None, d: int = 0,
                     max_p: int = MAX_P, max_q: int = MAX_Q) -> DataFrame:
    """One row per series and (p, q) without (0, 0): aic, bic, sigma2, n, const, ar, ma.

    All orders are solved from one matrix of cross products per series.
    """
    e = with_innovations(difference(df, keys, time, y, orders, d), keys, time)
    wide = framed(e, keys, [time], max(max_p, max_q), 0, lambda w: {
        "__row": F.array(F.lit(1.0), *_lags(w, "z", max_p), *_lags(w, "e", max_q), F.col("z"))})
    grams = cross_products(wide, [*keys, "d"], "__row")

    def solve(g: np.ndarray, row: dict) -> list[dict]:
        n, const, out = g[0, 0], [0] if row["d"] == 0 else [], []
        for p in range(max_p + 1):
            for q in range(max_q + 1):
                if p + q == 0:
                    continue
                use = const + list(range(1, 1 + p)) + list(range(1 + max_p, 1 + max_p + q))
                coef, rss, _ = ols(g, use)
                k, log = len(use) + 1, n * (math.log(2 * math.pi * rss / n) + 1)
                c = len(const)
                out.append({"p": p, "q": q, "aic": log + 2 * k, "bic": log + k * math.log(n), "sigma2": rss / n, "n": int(n),
                            "const": float(coef[0]) if c else 0.0, "ar": coef[c:c + p].tolist(), "ma": coef[c + p:].tolist()})
        return out

    return solve_each(grams, [*keys, "d"], solve, "p int, q int, aic double, bic double, sigma2 double, n bigint, "
                      "const double, ar array<double>, ma array<double>")


def arima_fit(df: DataFrame, keys: list[str], time: str, y: str, orders: DataFrame | None = None, d: int = 0,
              order: tuple[int, int] | None = None) -> DataFrame:
    """Best (p, q) per series by AIC, or the given one."""
    all_orders = arima_candidates(df, keys, time, y, orders, d)
    if order:
        return all_orders.where((F.col("p") == order[0]) & (F.col("q") == order[1]))
    names = [c for c in all_orders.columns if c not in keys]
    best = all_orders.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("aic", "p", "q")).alias("s"))
    return best.select(*keys, "s.*")


def arima_diagnostics(fits: DataFrame, keys: list[str]) -> DataFrame:
    return fits.select(*keys, "aic", "bic", F.concat_ws(",", "p", "d", "q").alias("order"), F.col("n").alias("n_observations"))


def _tail(df: DataFrame, keys: list[str], time: str, values: list[str], rows: int) -> DataFrame:
    """(keys..., tail): the last rows per series, oldest first; the rank limit is applied map-side."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    last = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= rows)
    return last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(time, *values))).alias("tail"))


def arima_forecast(df: DataFrame, keys: list[str], time: str, y: str, fits: DataFrame, steps: int, alpha: float = 0.05) -> DataFrame:
    """(keys..., step, mean, lower, upper) from the last rows of each series and its fit."""
    e = with_innovations(difference(df, keys, time, y, fits), keys, time)
    state = _tail(e, keys, time, [y, "z", "e"], max(MAX_P, MAX_Q, MAX_D)).join(fits, keys)
    width = _normal_quantile(1 - alpha / 2)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                for h, mean, spread in _extend(r, y, steps):
                    out.append((*[r[k] for k in keys], h, mean, mean - width * spread, mean + width * spread))
            yield pd.DataFrame(out, columns=[*keys, "step", "mean", "lower", "upper"])

    return state.mapInPandas(run, f"{key_schema}, step int, mean double, lower double, upper double")


def _extend(r: dict, y: str, steps: int) -> list[tuple[int, float, float]]:
    tail, ar, ma, d = list(r["tail"]), np.asarray(r["ar"]), np.asarray(r["ma"]), int(r["d"])
    z, e, last = [t["z"] for t in tail], [t["e"] for t in tail], [t[y] for t in tail]
    psi, out, total = [1.0], [], 0.0
    for h in range(1, steps + 1):
        new = r["const"] + sum(a * z[-1 - i] for i, a in enumerate(ar)) + sum(m * e[-1 - i] for i, m in enumerate(ma))
        z.append(new)
        e.append(0.0)
        last.append(new if d == 0 else last[-1] + new if d == 1 else 2 * last[-1] - last[-2] + new)
        weights = np.array(psi)
        for _ in range(d):
            weights = np.cumsum(weights)
        total = float((weights ** 2).sum())
        out.append((h, float(last[-1]), math.sqrt(r["sigma2"] * total)))
        psi.append(sum(a * psi[-1 - i] for i, a in enumerate(ar) if i < len(psi)) + (ma[h - 1] if h <= len(ma) else 0.0))
    return out


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


# ---- trend and seasonality ----

CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
# Period in days and Fourier order of each seasonality.
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}
SEASON_SCALE, CHANGEPOINT_SCALE = 10.0, 0.05
INTERVAL = 0.8


def season_flags(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys..., __yearly, __weekly, __daily): seasonalities each series can show, being long and dense enough."""
    day = 86_400_000_000
    spans = df.groupBy(*keys).agg(((F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / day).alias("__days"), F.count("*").alias("__n"))
    gap = F.coalesce(F.try_divide("__days", F.col("__n") - 1), F.lit(1e9))
    rules = (("yearly", 730, 365), ("weekly", 14, 7), ("daily", 2, 1))
    return spans.select(*keys, *[((F.col("__days") >= need) & (gap < widest)).alias(f"__{s}") for s, need, widest in rules])


def auto_seasons(df: DataFrame, keys: list[str], time: str) -> list[str]:
    """Seasonalities that at least one series can show."""
    r = season_flags(df, keys, time).agg(*[F.max(f"__{s}").alias(s) for s in SEASONS]).first()
    return [s for s in SEASONS if r[s]]


def _design(time: str, seasons: list[str], extra: list[str], flagged: bool = False) -> tuple[Column, dict[str, tuple[int, int]]]:
    """Design row as an array expression and the slice (from 1, length) of each part; needs `__start` and `__end`.

    With `flagged` a season is zero where its flag column is false.
    """
    t = (F.unix_micros(time) - F.unix_micros("__start")) / F.greatest(F.unix_micros("__end") - F.unix_micros("__start"), F.lit(1))
    cells = [F.lit(1.0), t]
    cells += [F.greatest(t - CHANGEPOINT_RANGE * (j + 1) / (CHANGEPOINTS + 1), F.lit(0.0)) for j in range(CHANGEPOINTS)]
    parts = {"trend": (1, len(cells))}
    days = F.unix_micros(time) / 86_400_000_000
    for s in seasons:
        period, order = SEASONS[s]
        start = len(cells) + 1
        for k in range(1, order + 1):
            angle = 2 * math.pi * k / period * days
            waves = [F.sin(angle), F.cos(angle)]
            cells += [F.when(F.col(f"__{s}"), x).otherwise(0.0) for x in waves] if flagged else waves
        parts[s] = (start, 2 * order)
    if extra:
        parts["extra"] = (len(cells) + 1, len(extra))
        cells += [F.col(c).cast("double") for c in extra]
    return F.array(*cells), parts


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def with_holidays(df: DataFrame, time: str, holidays: DataFrame, names: list[str]) -> DataFrame:
    """Add a 0/1 column per named holiday; `holidays` has (ds date, holiday), one row per day and name."""
    wide = holidays.groupBy(F.col("ds").cast("date").alias("__ds")).agg(*[F.max((F.col("holiday") == n).cast("double")).alias(n) for n in names])
    return df.join(maybe_broadcast(wide), F.to_date(time) == F.col("__ds"), "left").drop("__ds").fillna(0.0, names)


def seasonal_fit(df: DataFrame, keys: list[str], time: str, y: str, seasons: list[str] | None = None, extra: list[str] = [],
                 multiplicative: bool = False, season_scale: float = SEASON_SCALE, changepoint_scale: float = CHANGEPOINT_SCALE) -> DataFrame:
    """(keys..., start, end, scale, sigma, coef): piecewise-linear trend and Fourier seasons by ridge regression.

    Without `seasons` each series gets those it can show itself; the coefficients of the others are zero, so that
    forecasts take the union of all. The multiplicative form fits the logarithm of a positive y.
    """
    data = df.where(F.col(y).isNotNull())
    flagged = seasons is None
    if flagged:
        flags = checkpointed(season_flags(data, keys, time))
        seasons = auto_seasons(data, keys, time)
        data = data.join(maybe_broadcast(flags), keys)
    value = F.log(y) if multiplicative else F.col(y).cast("double")
    ends = data.groupBy(*keys).agg(F.min(time).alias("__start"), F.max(time).alias("__end"), F.max(F.abs(value)).alias("__scale"))
    design, _ = _design(time, seasons, extra, flagged)
    rows = data.join(maybe_broadcast(ends), keys).withColumn(
        "__row", F.concat(design, F.array(value / F.greatest("__scale", F.lit(1e-300)))))
    grams = cross_products(rows, keys, "__row")
    seasonal = sum(2 * SEASONS[s][1] for s in seasons)

    def solve(g: np.ndarray, row: dict) -> list[dict]:
        n, use = g[0, 0], list(range(len(g) - 1))
        weight = np.concatenate([np.full(2, 1e-8), np.full(CHANGEPOINTS, changepoint_scale ** -2), np.full(seasonal, season_scale ** -2),
                                 np.full(len(use) - 2 - CHANGEPOINTS - seasonal, season_scale ** -2)])
        noise = 0.01
        for _ in range(5):  # the noise level sets how strongly the priors pull
            coef, rss, _ = ols(g, use, weight * noise)
            noise = max(rss / n, 1e-12)
        return [{"sigma": math.sqrt(noise), "n": int(n), "coef": coef.tolist()}]

    fits = solve_each(grams, keys, solve, "sigma double, n bigint, coef array<double>")
    return fits.join(ends, keys).select(
        *keys, F.col("__start").alias("start"), F.col("__end").alias("end"), F.col("__scale").alias("scale"), "sigma", "n", "coef",
        F.lit(",".join(seasons)).alias("seasons"), F.lit(multiplicative).alias("multiplicative"))


def predict_at_dates(dates: DataFrame, keys: list[str], time: str, fits: DataFrame, seasons: list[str], extra: list[str] = []) -> DataFrame:
    """yhat with its band and every component at the given times."""
    design, parts = _design(time, seasons, extra)
    side = maybe_broadcast(fits.withColumnsRenamed({"start": "__start", "end": "__end"}))
    rows = dates.join(side, keys).withColumn("__x", design)
    width = _normal_quantile(0.5 + INTERVAL / 2)
    comps = {name: _dot(F.slice("__x", a, n), F.slice("coef", a, n)) * F.col("scale") for name, (a, n) in parts.items()}
    rows = rows.withColumns(comps)
    total = sum((F.col(c) for c in comps), F.lit(0.0))
    band = width * F.col("sigma") * F.col("scale")
    lift = lambda c: F.when(F.col("multiplicative"), F.exp(c)).otherwise(c)
    return rows.select(*dates.columns, lift(total).alias("yhat"), lift(total - band).alias("yhat_lower"), lift(total + band).alias("yhat_upper"), *comps)


def seasonal_forecast(fits: DataFrame, keys: list[str], time: str, periods: int, freq: str, seasons: list[str],
                      regressors: DataFrame | None = None, extra: list[str] = []) -> DataFrame:
    """The `periods` times after each series' end.

    `regressors` has the keys, the time and the `extra` columns of the fit for the times to come; a missing value is 0.
    """
    step = {"D": "INTERVAL 1 DAY", "H": "INTERVAL 1 HOUR", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH"}[freq]
    first = F.col("end") + F.expr(step)
    last = F.col("end") + F.expr(step) * periods
    dates = fits.select(*keys, F.explode(F.sequence(first, last, F.expr(step))).alias(time))
    if extra:
        dates = dates.join(regressors.select(*keys, time, *extra), [*keys, time], "left").fillna(0.0, extra)
    return predict_at_dates(dates, keys, time, fits, seasons, extra)


def seasonal_components(df: DataFrame, keys: list[str], time: str, fits: DataFrame, seasons: list[str]) -> DataFrame:
    out = predict_at_dates(df.select(*keys, time), keys, time, fits, seasons)
    return out.select(*keys, time, "trend", *seasons)


def prepare_ds_y(df: DataFrame) -> DataFrame:
    """(ds, y): the first time column and the first numeric column."""
    ds = next(f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.DateType)) or "date" in f.name.lower())
    y = next(f.name for f in df.schema.fields if is_numeric(f.dataType))
    return df.select(F.col(ds).cast("timestamp").alias("ds"), F.col(y).alias("y"))


# ---- rolling origin ----

def cv_cutoffs(df: DataFrame, keys: list[str], time: str, initial: int = 365, period: int = 30, horizon: int = 30) -> DataFrame:
    """(keys..., cutoff): from `initial` days after the start, back from `horizon` days before the end."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    last = F.col("b") - F.make_dt_interval(F.lit(horizon))
    first = F.col("a") + F.make_dt_interval(F.lit(initial))
    usable = ends.where(last >= first)
    return usable.select(*keys, F.explode(F.sequence(last, first, F.make_dt_interval(F.lit(-period)))).alias("cutoff"))


def cv_windows(df: DataFrame, keys: list[str], time: str, cutoffs: DataFrame, horizon: int = 30) -> DataFrame:
    """Rows beside each cutoff of their series that trains on or tests with them, with `role`."""
    lists = cutoffs.groupBy(*keys).agg(F.collect_list("cutoff").alias("__c"))  # one cutoff per period of the span
    rows = df.join(maybe_broadcast(lists), keys).withColumn("cutoff", F.explode("__c")).drop("__c")
    test = (F.col(time) > F.col("cutoff")) & (F.col(time) <= F.col("cutoff") + F.make_dt_interval(F.lit(horizon)))
    return rows.withColumn("role", F.when(F.col(time) <= F.col("cutoff"), "train").when(test, "test")).where(F.col("role").isNotNull())


def rolling_origin_cv(df: DataFrame, keys: list[str], time: str, y: str, initial: int = 365, period: int = 30, horizon: int = 30,
                      seasons: list[str] | None = None) -> DataFrame:
    """(keys..., cutoff, rmse, mae, mape, r2) of the seasonal model refitted at every cutoff.

    Without `seasons` every fit has those that the training rows of its own series and cutoff can show.
    """
    rows = cv_windows(df, keys, time, cv_cutoffs(df, keys, time, initial, period, horizon), horizon)
    both = [*keys, "cutoff"]
    train = rows.where("role = 'train'")
    shown = auto_seasons(train.where(F.col(y).isNotNull()), both, time) if seasons is None else seasons
    fits = seasonal_fit(train, both, time, y, seasons)
    preds = predict_at_dates(rows.where("role = 'test'"), both, time, fits, shown)
    return evaluate.regression_metrics(preds, both, y, "yhat")


def cv_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("mape", "rmse", "mae")])


# ---- next value from the last values ----

def lookback_regression(df: DataFrame, keys: list[str], time: str, y: str, lookback: int, steps: int) -> DataFrame:
    """(keys..., step, yhat): regression of the next value on the last ones, fed its own output for later steps."""
    wide = framed(df.where(F.col(y).isNotNull()), keys, [time], lookback, 0, lambda w: {
        "__row": F.array(F.lit(1.0), *[F.lag(y, k).over(w).cast("double") for k in range(1, lookback + 1)], F.col(y).cast("double"))})

    def solve(g: np.ndarray, row: dict) -> list[dict]:
        return [{"coef": ols(g, list(range(len(g) - 1)))[0].tolist()}]

    fits = solve_each(cross_products(wide, keys, "__row"), keys, solve, "coef array<double>")
    state = _tail(df.where(F.col(y).isNotNull()), keys, time, [y], lookback).join(fits, keys).where(F.size("tail") == lookback)
    x = F.reverse(F.transform("tail", lambda s: s[y].cast("double")))  # newest first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(x.alias("x"), F.array().cast("array<double>").alias("out")),
        lambda s, i: _advance(s, lookback), lambda s: s["out"])
    return state.select(*keys, F.posexplode(walk).alias("step", "yhat")).withColumn("step", F.col("step") + 1)


def _advance(s: Column, lookback: int) -> Column:
    new = F.element_at("coef", 1) + _dot(s["x"], F.slice("coef", 2, lookback))
    return F.struct(F.slice(F.concat(F.array(new), s["x"]), 1, lookback).alias("x"), F.concat(s["out"], F.array(new)).alias("out"))
