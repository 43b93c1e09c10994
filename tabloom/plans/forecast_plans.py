"""Forecasting queries: hourly means per event type, daily means per order status."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.cells import tidy
from tabloom.operators import forecast as fc
from tabloom.operators import sarimax
from tabloom.operators import timeseries as ts
from tabloom.plans.frames import READINGS
from tabloom.plans.registry import query
from tabloom.session import checkpointed, load

KEYS = ["series"]


def hourly(spark, d):
    """(series, ts, y): filled hourly mean of the raw readings."""
    t = READINGS(spark, d).select("series", "ts", F.col("raw").alias("y"))
    return checkpointed(ts.ts_prepare(t, KEYS, "ts", ["y"], "H", "ffill"))


def daily(spark, d):
    t = load(spark, d, "orders").select(F.col("o_orderstatus").alias("series"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"))
    return checkpointed(ts.resample_mean(t, KEYS, "ts", ["y"], "D"))


@query("adf_order")
def difference_order(spark, d):
    return fc.adf_order(hourly(spark, d), KEYS, "ts", "y")


@query("arima_fit")
def hourly_arima(spark, d):
    t = hourly(spark, d)
    return fc.arima_fit(t, KEYS, "ts", "y", checkpointed(fc.adf_order(t, KEYS, "ts", "y")))


@query("arima_forecast")
def hourly_arima_ahead(spark, d):
    t = hourly(spark, d)
    return fc.arima_forecast(t, KEYS, "ts", "y", checkpointed(fc.arima_fit(t, KEYS, "ts", "y", checkpointed(fc.adf_order(t, KEYS, "ts", "y")))), 24)


@query("arima_diagnostics")
def hourly_arima_checks(spark, d):
    t = hourly(spark, d)
    return fc.arima_diagnostics(fc.arima_fit(t, KEYS, "ts", "y", checkpointed(fc.adf_order(t, KEYS, "ts", "y"))), KEYS)


@query("seasonal_fit")
def daily_seasons(spark, d):
    return fc.seasonal_fit(daily(spark, d), KEYS, "ts", "y")


@query("seasonal_forecast")
def daily_ahead(spark, d):
    t = daily(spark, d)
    seasons = fc.auto_seasons(t, KEYS, "ts")
    return fc.seasonal_forecast(fc.seasonal_fit(t, KEYS, "ts", "y"), KEYS, "ts", 30, "D", seasons)


@query("seasonal_components")
def daily_parts(spark, d):
    t = daily(spark, d)
    seasons = fc.auto_seasons(t, KEYS, "ts")
    return fc.seasonal_components(t, KEYS, "ts", fc.seasonal_fit(t, KEYS, "ts", "y"), seasons)


@query("prepare_ds_y", "SELECT o_orderdate AS ds, o_orderkey AS y FROM orders")
def orders_series(spark, d):
    return fc.prepare_ds_y(load(spark, d, "orders"))


@query("rolling_origin_cv")
def daily_cv(spark, d):
    return fc.rolling_origin_cv(daily(spark, d), KEYS, "ts", "y")


@query("cv_metrics")
def daily_cv_summary(spark, d):
    return fc.cv_metrics(fc.rolling_origin_cv(daily(spark, d), KEYS, "ts", "y"), KEYS)


_CUT_SQL = """WITH r AS (SELECT o_orderstatus AS series, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
c AS (SELECT series, unnest(generate_series(b - INTERVAL 30 DAY, a + INTERVAL 365 DAY, INTERVAL (-30) DAY)) AS cutoff FROM r)"""


@query("cv_cutoffs", _CUT_SQL + """ SELECT c.series, c.cutoff, count(*) FILTER (WHERE o_orderdate <= cutoff) AS train_rows,
 count(*) FILTER (WHERE o_orderdate > cutoff AND o_orderdate <= cutoff + INTERVAL 30 DAY) AS test_rows
FROM c JOIN orders ON o_orderstatus = c.series GROUP BY 1, 2""")
def order_cutoffs(spark, d):
    t = load(spark, d, "orders").select(F.col("o_orderstatus").alias("series"), F.col("o_orderdate").alias("ts"))
    rows = fc.cv_windows(t, KEYS, "ts", fc.cv_cutoffs(t, KEYS, "ts"))
    return rows.groupBy("series", "cutoff").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows"))


@query("lookback_regression")
def hourly_lookback(spark, d):
    return fc.lookback_regression(hourly(spark, d), KEYS, "ts", "y", 24, 12)


_HOURLY_SQL = """t AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1, 2),
c AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM t GROUP BY 1),
g AS (SELECT c.series, c.ts, last_value(t.y IGNORE NULLS) OVER (PARTITION BY c.series ORDER BY c.ts ROWS UNBOUNDED PRECEDING) AS y
 FROM c LEFT JOIN t ON c.series = t.series AND c.ts = t.ts),
l AS (SELECT series, ts, y, lag(y) OVER (PARTITION BY series ORDER BY ts) AS x, row_number() OVER (PARTITION BY series ORDER BY ts) AS k FROM g)"""


@query("arima_first_order", f"""WITH {_HOURLY_SQL}, r AS (SELECT * FROM l WHERE k > {fc.LONG_AR + fc.MAX_Q})
SELECT series, round(regr_slope(y, x), 5) AS ar, round(regr_intercept(y, x), 4) AS const,
 round((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / count(*), 4) AS sigma2, count(*) AS n FROM r GROUP BY 1""")
def hourly_ar1(spark, d):
    fit = fc.arima_fit(hourly(spark, d), KEYS, "ts", "y", order=(1, 0))
    return fit.select("series", tidy(F.col("ar")[0], 5).alias("ar"), tidy(F.col("const"), 4).alias("const"), tidy(F.col("sigma2"), 4).alias("sigma2"), "n")


@query("lookback_line", f"""WITH {_HOURLY_SQL}, f AS (SELECT series, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, arg_max(y, ts) AS last FROM l GROUP BY 1)
SELECT series, 1 AS step, round(a * last + b, 3) AS yhat FROM f UNION ALL SELECT series, 2, round(a * (a * last + b) + b, 3) FROM f""")
def hourly_next(spark, d):
    return fc.lookback_regression(hourly(spark, d), KEYS, "ts", "y", 1, 2).withColumn("yhat", tidy(F.col("yhat"), 3))


# ---- seasonal ARIMA with regressors ----

DAYS_SQL = "SELECT o_orderstatus AS series, o_orderdate AS ts, avg(o_totalprice) / 1000 AS y, CAST(day(o_orderdate) AS DOUBLE) AS x FROM orders GROUP BY ALL"
WEEKLY = sarimax.Spec((1, 0, 1), (1, 0, 0, 7), ("x",))


def days(spark, d):
    """One row per order status and day: the mean price, and the day of the month as a regressor."""
    t = load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("series"), F.col("o_orderdate").alias("ts"))
    t = t.agg((F.avg("o_totalprice") / 1000).alias("y"))
    return t.withColumn("x", F.dayofmonth("ts").cast("double"))


@query("sarimax_fit")
def weekly_orders(spark, d):
    return sarimax.fit(days(spark, d), KEYS, "ts", "y", WEEKLY)


@query("sarimax_forecast")
def weekly_orders_ahead(spark, d):
    t = days(spark, d)
    steps = t.select("series").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(14)))).withColumn("x", F.col("step").cast("double"))
    return sarimax.forecast(t, KEYS, "ts", "y", sarimax.fit(t, KEYS, "ts", "y", WEEKLY), WEEKLY, 14, steps)


# without an ARMA part the likelihood is that of a regression
@query("sarimax_line", f"""WITH t AS ({DAYS_SQL}), r AS (SELECT series, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
 (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*) AS s FROM t GROUP BY 1 HAVING count(*) > 3)
SELECT series, n, round(a, 5) AS constant, round(b, 6) AS slope, round(s, 4) AS sigma2, round(n * (ln(2 * pi() * s) + 1) + 6, 4) AS aic FROM r""")
def regression_of_orders(spark, d):
    fits = sarimax.fit(days(spark, d), KEYS, "ts", "y", sarimax.Spec((0, 0, 0), exog=("x",)))
    return fits.select("series", "n", tidy(F.col("constant"), 5).alias("constant"), tidy(F.col("exog")[0], 6).alias("slope"),
                       tidy(F.col("sigma2"), 4).alias("sigma2"), tidy(F.col("aic"), 4).alias("aic"))


# a seasonal random walk repeats the last season
@query("sarimax_walk", f"""WITH t AS ({DAYS_SQL}), z AS (SELECT *, y - lag(y, 7) OVER (PARTITION BY series ORDER BY ts) AS z,
 row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS back FROM t), v AS (SELECT series, avg(z * z) AS s FROM z GROUP BY 1 HAVING count(z) > 1)
SELECT z.series, CAST(8 - back AS INTEGER) AS step, round(y, 6) AS mean, round(y - 1.959963984540054 * sqrt(s), 4) AS lower FROM z JOIN v ON v.series = z.series WHERE back <= 7""")
def repeated_week(spark, d):
    t, spec = days(spark, d), sarimax.Spec((0, 0, 0), (0, 1, 0, 7))
    out = sarimax.forecast(t, KEYS, "ts", "y", sarimax.fit(t, KEYS, "ts", "y", spec), spec, 7)
    return out.select("series", "step", tidy(F.col("mean"), 6).alias("mean"), tidy(F.col("lower"), 4).alias("lower"))
