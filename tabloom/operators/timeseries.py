"""Time-series preparation for many series at once.

Every operator takes the series key columns and the time order. Windows go through
`functions.ordering`, so a series with a large share of the rows is cut into chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ordering import MAX_ROWS, carried, framed, row_positions
from tabloom.functions.quantiles import DIRECT_ROWS, exact_quantiles
from tabloom.operators import prep
from tabloom.session import maybe_broadcast

LAGS = [1, 7, 14, 30]
WINDOWS = [7, 14, 30]
CLIP = (0.01, 0.99)


def bucket(ts: Column, freq: str) -> Column:
    """Label of the regular bucket: D, H, W (its Sunday) or M (its last day)."""
    if freq == "W":
        return F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")
    if freq == "M":
        return F.last_day(ts).cast("timestamp")
    return F.date_trunc({"D": "day", "H": "hour"}[freq], ts)


def resample_mean(df: DataFrame, keys: list[str], time: str, values: list[str], freq: str) -> DataFrame:
    """Mean per bucket; empty buckets between a series' ends are kept with NULL."""
    means = df.groupBy(*keys, bucket(F.col(time), freq).alias(time)).agg(*[F.avg(v).alias(v) for v in values])
    step = {"D": "INTERVAL 1 DAY", "H": "INTERVAL 1 HOUR", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH"}[freq]
    ends = means.groupBy(*keys).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    spots = F.sequence(F.date_trunc("month", "__a") if freq == "M" else F.col("__a"),
                       F.date_trunc("month", "__b") if freq == "M" else F.col("__b"), F.expr(step))
    calendar = ends.select(*keys, F.explode(spots).alias("__t"))
    calendar = calendar.select(*keys, (bucket(F.col("__t"), "M") if freq == "M" else F.col("__t")).alias(time))
    return calendar.join(means, [*keys, time], "left")


def fill_forward(df, keys, order, values: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    return carried(df, keys, order, {v: F.col(v) for v in values}, True, max_rows)


def fill_backward(df, keys, order, values: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    return carried(df, keys, order, {v: F.col(v) for v in values}, False, max_rows)


def fill_zero(df, values: list[str]) -> DataFrame:
    return df.fillna(0, values)


def fill_interpolate(df, keys, order, values: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Linear by row position; leading gaps stay, trailing gaps take the last value."""
    placed = row_positions(df, keys, order, "__row", max_rows)
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col("__row").alias("p"), F.col(v).cast("double").alias("x")))
             for v in values}
    both = carried(placed, keys, ["__row"], {f"__a_{v}": k for v, k in known.items()}, True, max_rows)
    both = carried(both, keys, ["__row"], {f"__b_{v}": k for v, k in known.items()}, False, max_rows)

    def between(v: str) -> Column:
        a, b = F.col(f"__a_{v}"), F.col(f"__b_{v}")
        slope = (b["x"] - a["x"]) / (b["p"] - a["p"])
        return (F.when(F.col(v).isNotNull(), F.col(v).cast("double"))
                .when(a.isNull(), None).when(b.isNull(), a["x"])
                .otherwise(a["x"] + slope * (F.col("__row") - a["p"])))

    return both.withColumns({v: between(v) for v in values}).drop(
        "__row", *[f"__{s}_{v}" for s in "ab" for v in values])


def winsorize(df, keys, values: list[str], limits=CLIP, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Clip to the exact quantiles of each series."""
    for v in values:
        cuts = exact_quantiles(df, keys, v, list(limits), direct_rows)
        cuts = cuts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("q0").alias("__lo"), F.col("q1").alias("__hi"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        df = df.join(maybe_broadcast(cuts), on, "left").withColumn(
            v, F.when(F.col(v).isNotNull(), F.least(F.greatest(F.col(v), F.col("__lo")), F.col("__hi")))).drop(
            "__lo", "__hi", *[f"__k_{k}" for k in keys])
    return df


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Quarter, year, weekend and month ends."""
    return {
        "quarter": F.quarter(ts), "year": F.year(ts), "is_weekend": F.weekday(ts) >= 5,
        "is_month_start": F.dayofmonth(ts) == 1, "is_month_end": F.to_date(ts) == F.last_day(ts),
    }


def time_features(df: DataFrame, time: str) -> DataFrame:
    ts = F.col(time)
    return df.withColumns({
        "hour": F.hour(ts), "day_of_week": F.weekday(ts), "day_of_month": F.dayofmonth(ts), "month": F.month(ts),
        **calendar_columns(ts)})


def cyclical_features(df: DataFrame, time: str) -> DataFrame:
    """Sine and cosine of hour, weekday, day and month, so ends of a cycle meet."""
    ts = F.col(time)
    # Cycle lengths.
    cycles = {"hour": (F.hour(ts), 24.0), "day_of_week": (F.weekday(ts), 7.0),
              "day_of_month": (F.dayofmonth(ts), 31.0), "month": (F.month(ts), 12.0)}
    waves = {f"{n}_{s}": fn(2 * F.pi() * x / p) for n, (x, p) in cycles.items() for s, fn in (("sin", F.sin), ("cos", F.cos))}
    return df.withColumns({**waves, **calendar_columns(ts)})


def lag_features(df, keys, order, value: str, lags: list[int] = LAGS, max_rows: int = MAX_ROWS) -> DataFrame:
    return framed(df, keys, order, max(lags), 0,
                  lambda w: {f"{value}_lag_{k}": F.lag(value, k).over(w) for k in lags}, max_rows)


def lag_difference(df, keys, order, value: str, lag: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """Value minus the value `lag` rows before."""
    return framed(df, keys, order, lag, 0,
                  lambda w: {f"{value}_diff_{lag}": F.col(value) - F.lag(value, lag).over(w)}, max_rows)


def rolling_features(df, keys, order, value: str, windows: list[int] = WINDOWS, max_rows: int = MAX_ROWS) -> DataFrame:
    """Mean, std, min and max over the last k rows; NULL until k values are present."""

    def build(w):
        out = {}
        for k in windows:
            frame = w.rowsBetween(-(k - 1), 0)
            full = F.count(value).over(frame) == k
            for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                out[f"{value}_rolling_{name}_{k}"] = F.when(full, fn(value).over(frame))
        return out

    return framed(df, keys, order, max(windows) - 1, 0, build, max_rows)


def sequence_windows(df, keys, order, value: str, lookback: int, horizon: int = 1, max_rows: int = MAX_ROWS) -> DataFrame:
    """Arrays of `lookback` values and the next `horizon` values; full windows only."""

    def build(w):
        out = {"x": F.collect_list(value).over(w.rowsBetween(-(lookback - 1), 0))}
        for h in range(1, horizon + 1):
            out[f"y{h}"] = F.lead(value, h).over(w)
        return out

    wide = framed(df, keys, order, lookback - 1, horizon, build, max_rows)
    return wide.where((F.size("x") == lookback) & F.col(f"y{horizon}").isNotNull())


def ts_scale(df: DataFrame, fitted_on: DataFrame, values: list[str], robust: bool = True) -> DataFrame:
    """Scale with parameters of the raw rows."""
    fit = prep.fit_robust if robust else prep.fit_standard
    return prep.scale(df, fit(fitted_on, values))


FILLS = {"ffill": fill_forward, "bfill": fill_backward, "interpolate": fill_interpolate}


def ts_prepare(df, keys, time: str, values: list[str], freq: str | None = None, fill: str = "ffill",
               clip: bool = False, robust: bool | None = None) -> DataFrame:
    """Resample, fill, clip, scale, in this order; scaling is fitted on the raw rows."""
    out = resample_mean(df, keys, time, values, freq) if freq else df
    out = FILLS[fill](out, keys, [time], values) if fill in FILLS else fill_zero(out, values)
    if clip:
        out = winsorize(out, keys, values)
    return out if robust is None else ts_scale(out, df, values, robust)
