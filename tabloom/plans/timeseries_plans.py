"""Time-series preparation queries: one series per event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.cells import tidy
from tabloom.operators import timeseries as ts
from tabloom.plans.frames import READINGS
from tabloom.plans.registry import query

R = f"WITH t AS ({READINGS.sql}) "
W = "PARTITION BY series ORDER BY ts, event_id"
KEYS, ORDER = ["series"], ["ts", "event_id"]

LABELS = {"H": "date_trunc('hour', ts)", "D": "date_trunc('day', ts)", "W": "date_trunc('week', ts) + INTERVAL 6 DAY",
          "M": "CAST(last_day(ts) AS TIMESTAMP)"}
STEPS = {"H": "1 HOUR", "D": "1 DAY", "W": "7 DAY"}


def resample_sql(freq: str, fn: str = "round(avg(value), 6)") -> str:
    return f"""m AS (SELECT series, {LABELS[freq]} AS ts, {fn} AS value FROM t GROUP BY 1, 2),
c AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL {STEPS[freq]})) AS ts FROM m GROUP BY 1),
g AS (SELECT c.series, c.ts, m.value FROM c LEFT JOIN m ON c.series = m.series AND c.ts = m.ts)"""


@query("resample_mean", R + ", " + resample_sql("H") + " SELECT series, ts, value FROM g")
def hourly(spark, d):
    return ts.resample_mean(READINGS(spark, d), KEYS, "ts", ["value"], "H").withColumn("value", tidy(F.col("value")))


@query("resample_weekly", R + ", " + resample_sql("W") + " SELECT series, ts, value FROM g")
def weekly(spark, d):
    return ts.resample_mean(READINGS(spark, d), KEYS, "ts", ["value"], "W").withColumn("value", tidy(F.col("value")))


@query("fill_forward", R + f"SELECT event_id, series, last_value(value IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS value FROM t")
def forward(spark, d):
    return ts.fill_forward(READINGS(spark, d), KEYS, ORDER, ["value"]).select("event_id", "series", "value")


@query("fill_backward", R + f"""SELECT event_id, series, first_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM t""")
def backward(spark, d):
    return ts.fill_backward(READINGS(spark, d), KEYS, ORDER, ["value"]).select("event_id", "series", "value")


@query("fill_interpolate", R + f""", r AS (SELECT *, row_number() OVER ({W}) AS p FROM t),
b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pa, last_value(value IGNORE NULLS) OVER a AS va,
 first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER z AS pb, first_value(value IGNORE NULLS) OVER z AS vb FROM r
 WINDOW a AS ({W} ROWS UNBOUNDED PRECEDING), z AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, series, round(CASE WHEN value IS NOT NULL THEN value WHEN va IS NULL THEN NULL WHEN vb IS NULL THEN va
 ELSE va + (vb - va) / (pb - pa) * (p - pa) END, 6) AS value FROM b""")
def interpolated(spark, d):
    out = ts.fill_interpolate(READINGS(spark, d), KEYS, ORDER, ["value"])
    return out.select("event_id", "series", tidy(F.col("value")).alias("value"))


@query("fill_zero", R + "SELECT event_id, series, coalesce(value, 0) AS value FROM t")
def zeroed(spark, d):
    return ts.fill_zero(READINGS(spark, d), ["value"]).select("event_id", "series", "value")


@query("winsorize", R + """, q AS (SELECT series, quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM t GROUP BY 1)
SELECT event_id, t.series, round(least(greatest(raw, lo), hi), 6) AS raw FROM t JOIN q ON t.series = q.series""")
def clipped(spark, d):
    out = ts.winsorize(READINGS(spark, d), KEYS, ["raw"])
    return out.select("event_id", "series", tidy(F.col("raw")).alias("raw"))


CAL = """CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year, isodow(ts) >= 6 AS is_weekend, day(ts) = 1 AS is_month_start,
 CAST(ts AS DATE) = last_day(ts) AS is_month_end"""


@query("time_features", R + f"""SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
 CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month, {CAL} FROM t""")
def parts_of_time(spark, d):
    return ts.time_features(READINGS(spark, d), "ts").drop("ts", "series", "value", "raw")


def _wave(name: str, x: str, p: int) -> str:
    return ", ".join(f"round({f}(2 * pi() * {x} / {p}.0), 6) + 0.0 AS {name}_{f}" for f in ("sin", "cos"))


@query("cyclical_features", R + f"""SELECT event_id, {_wave('hour', 'hour(ts)', 24)}, {_wave('day_of_week', '(isodow(ts) - 1)', 7)},
 {_wave('day_of_month', 'day(ts)', 31)}, {_wave('month', 'month(ts)', 12)}, {CAL} FROM t""")
def waves_of_time(spark, d):
    out = ts.cyclical_features(READINGS(spark, d), "ts").drop("ts", "series", "value", "raw")
    return out.withColumns({c: tidy(F.col(c)) for c in out.columns if c.endswith(("_sin", "_cos"))})


@query("lag_features", R + "SELECT event_id, " + ", ".join(f"lag(raw, {k}) OVER ({W}) AS raw_lag_{k}" for k in ts.LAGS) + " FROM t")
def lagged(spark, d):
    return ts.lag_features(READINGS(spark, d), KEYS, ORDER, "raw").drop("ts", "series", "value", "raw")


@query("lag_difference", R + f"SELECT event_id, round(raw - lag(raw, 2) OVER ({W}), 6) + 0.0 AS raw_diff_2 FROM t")
def differenced(spark, d):
    out = ts.lag_difference(READINGS(spark, d), KEYS, ORDER, "raw", 2)
    return out.select("event_id", tidy(F.col("raw_diff_2")).alias("raw_diff_2"))


def _rolling_sql() -> str:
    cells = []
    for k in ts.WINDOWS:
        frame = f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cells.append(f"CASE WHEN count(value) OVER {frame} = {k} THEN round({fn}(value) OVER {frame}, 5) END AS value_rolling_{name}_{k}")
    return R + f"SELECT event_id, {', '.join(cells)} FROM t"


@query("rolling_features", _rolling_sql())
def rolling(spark, d):
    out = ts.rolling_features(READINGS(spark, d), KEYS, ORDER, "value").drop("ts", "series", "value", "raw")
    return out.withColumns({c: tidy(F.col(c), 5) for c in out.columns if "rolling" in c})


@query("ts_scale", R + """, q AS (SELECT quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS r FROM t)
SELECT event_id, round((coalesce(value, 0) - m) / r, 6) + 0.0 AS value FROM t, q""")
def scaled_readings(spark, d):
    raw = READINGS(spark, d)
    out = ts.ts_scale(ts.fill_zero(raw, ["value"]), raw, ["value"])
    return out.select("event_id", tidy(F.col("value")).alias("value"))


@query("ts_prepare", R + ", " + resample_sql("H", "avg(value)") + """,
f AS (SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM g),
q AS (SELECT series, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM f GROUP BY 1),
p AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM t)
SELECT f.series, f.ts, CASE WHEN value IS NOT NULL THEN round((least(greatest(value, lo), hi) - m) / s, 6) + 0.0 END AS value FROM f JOIN q ON f.series = q.series, p""")
def prepared(spark, d):
    out = ts.ts_prepare(READINGS(spark, d), KEYS, "ts", ["value"], "H", "ffill", clip=True, robust=False)
    return out.withColumn("value", tidy(F.col("value")))


@query("sequence_windows", R + f""", s AS (SELECT event_id, series, list(raw) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x, lead(raw) OVER ({W}) AS y1 FROM t)
SELECT event_id, series, x[1] AS first, x[5] AS last, round(list_sum(x), 6) AS total, y1 FROM s WHERE len(x) = 5 AND y1 IS NOT NULL""")
def windows(spark, d):
    out = ts.sequence_windows(READINGS(spark, d), KEYS, ORDER, "raw", 5)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return out.select("event_id", "series", F.element_at("x", 1).alias("first"), F.element_at("x", 5).alias("last"),
                      tidy(total).alias("total"), "y1")
