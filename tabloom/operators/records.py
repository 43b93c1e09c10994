"""Bookkeeping tables: experiments, jobs, payments, plans, quotas, notifications."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import MAX_ROWS, running_totals
from tabloom.session import maybe_broadcast

PAID_PLANS = ["pro", "advance"]
DAY_MICROS = 86_400_000_000
# Days one payment buys, by plan.
PLAN_DAYS = {"pro": 30, "advance": 365}
# Requests per minute.
FREE_RATE, PAID_RATE = 20, 200
# Free-plan limits.
FREE_RUNS_PER_DAY, FREE_DATASETS = 1, 3
# Whether an event is announced to a user without own settings.
NOTIFY_DEFAULTS = {
    "training_completed": True, "training_failed": True, "dataset_uploaded": False, "api_rate_limit": True,
    "weekly_report": False, "security_alerts": True, "product_updates": False, "billing_updates": True,
}
# Weight of each training phase in percent; any other phase weighs 10.
PHASE_WEIGHTS = {"preprocessing": 15, "feature_engineering": 15, "model_development": 40, "evaluation": 20, "ready": 10}


def experiment_status(experiments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each experiment beside its jobs; one row without job fields when it has none."""
    e = experiments.select(F.col("id").alias("experiment_id"), "name", F.col("status").alias("experiment_status"))
    j = jobs.select("experiment_id", "model", F.col("status").alias("job_status"), "score")
    return e.join(j, "experiment_id", "left")


def list_completed_models(experiments: DataFrame) -> DataFrame:
    return experiments.where(F.col("status") == "completed").orderBy(F.desc("created_at"), "id")


def unshared_files(datasets: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files of the deleted datasets that no remaining dataset uses."""
    gone = maybe_broadcast(deleted.select("dataset_id"))
    left = datasets.join(gone, "dataset_id", "left_anti").select("file_path")
    files = datasets.join(gone, "dataset_id", "left_semi").select("file_path").distinct()
    return files.join(left, "file_path", "left_anti")


def cascade_delete(experiments: DataFrame, jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """(kind, id, kept?) for experiments and jobs after the datasets in `deleted` are gone."""
    gone = maybe_broadcast(deleted.select("dataset_id").distinct())
    kept = experiments.join(gone, "dataset_id", "left_anti").select(F.col("id").alias("experiment_id"))
    e = kept.select(F.lit("experiment").alias("kind"), "experiment_id", F.lit(None).cast("string").alias("model"))
    j = jobs.join(kept, "experiment_id", "left_semi").select(F.lit("job").alias("kind"), "experiment_id", "model")
    return e.unionByName(j)


def concat_tables(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def money(paise: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(paise / 100, 2))


def billing_summary(payments: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: captured total and count beside the plan."""
    captured = F.col("status") == "captured"
    totals = payments.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(captured, F.col("amount"))), F.lit(0)).alias("total_spent"),
        F.count_if(captured).alias("successful_payments"))
    out = users.select("user_id", F.col("plan_type").alias("current_plan")).join(totals, "user_id", "left")
    out = out.fillna(0, ["total_spent", "successful_payments"])
    return out.withColumn("total_spent_display", money(F.col("total_spent")))


def payment_upsert(feed: DataFrame) -> DataFrame:
    """One row per order from a feed of payment messages (order_id, payment_id, happened, seq, status, amount).

    The last message decides; once captured an order stays captured, and a captured
    payment id is applied once, at its first message.
    """
    when = F.struct("happened", "seq")
    captured = F.col("status") == "captured"
    return feed.groupBy("order_id", "user_id").agg(
        F.coalesce(F.min_by("payment_id", F.when(captured, when)), F.max_by("payment_id", when)).alias("payment_id"),
        F.when(F.bool_or(captured), "captured").otherwise(F.max_by("status", when)).alias("status"),
        F.coalesce(F.min_by("amount", F.when(captured, when)), F.max_by("amount", when)).alias("amount"),
        F.coalesce(F.min(F.when(captured, F.col("happened"))), F.max("happened")).alias("applied_at"))


def plan_days(plan: Column) -> Column:
    return F.when(plan == "advance", PLAN_DAYS["advance"]).otherwise(PLAN_DAYS["pro"])


def plan_expiry_fold(payments: DataFrame, order: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Plan end per user when each payment extends from the later of its time and the current end.

    Folding end = max(t, end) + d over payments equals S_n + max_j(t_j - S_{j-1}) with S
    the running sum of the durations, so running totals and one maximum replace the
    ordered fold, and a user with very many payments is not gathered.
    """
    days = plan_days(F.col("plan")) * F.lit(DAY_MICROS)
    summed = running_totals(payments.withColumn("__d", days), ["user_id"], order, {"__s": F.col("__d")}, max_rows)
    start = F.unix_micros("happened") - (F.col("__s") - F.col("__d"))
    return summed.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("payments"),
        F.timestamp_micros(F.sum("__d") + F.max(start)).alias("plan_expires_at"),
        F.max_by("plan", F.struct("happened", *order)).alias("plan_type"))


def is_pro_active(plan: Column, expires: Column, now: datetime) -> Column:
    return F.coalesce(plan.isin(PAID_PLANS), F.lit(False)) & ~F.coalesce(expires < F.lit(now), F.lit(False))


def expired_plans(users: DataFrame, now: datetime) -> DataFrame:
    """Users whose paid plan has ended, moved to `free`; the end stays on record."""
    ended = F.col("plan_type").isin(PAID_PLANS) & (F.col("plan_expires_at") < F.lit(now))
    return users.where(ended).withColumn("plan_type", F.lit("free"))


def moving_count(df: DataFrame, keys: list[str], time: str, width: int, name: str = "hits") -> DataFrame:
    """(keys, time, n, hits): rows of the key in the closed-open span (time - width, time].

    `time` is an integer. Rows are first counted per (key, time); time is then cut into
    buckets of eight widths, and only the last width of a bucket is copied to the next,
    so a key with most of the rows is spread over its time buckets.
    """
    counts = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"))
    size = 8 * width
    home = F.floor(F.col(time) / size)
    near_end = F.pmod(F.col(time), F.lit(size)) >= size - width
    spread = counts.withColumn("__home", home).withColumn(
        "__bucket", F.explode(F.array_compact(F.array(home, F.when(near_end, home + 1)))))
    w = Window.partitionBy(*keys, "__bucket").orderBy(time).rangeBetween(-(width - 1), 0)
    return spread.withColumn(name, F.sum("n").over(w)).where(
        F.col("__home") == F.col("__bucket")).drop("__home", "__bucket")


def quota_24h(experiments: DataFrame, width: int = 86_400) -> DataFrame:
    """Per user and second of a run: runs in the 24 hours up to it, and whether a free user was over the limit before it."""
    timed = experiments.select("user_id", F.unix_seconds("created_at").alias("second"))
    out = moving_count(timed, ["user_id"], "second", width + 1, "runs_24h")
    return out.withColumn("blocked", F.col("runs_24h") - F.col("n") >= FREE_RUNS_PER_DAY)


def dataset_quota(datasets: DataFrame) -> DataFrame:
    """Datasets per free user and whether another upload is refused."""
    return datasets.groupBy("user_id").agg(F.count(F.lit(1)).alias("datasets")).withColumn(
        "blocked", F.col("datasets") >= FREE_DATASETS)


def rate_limit_hits(requests: DataFrame, paid: Column) -> DataFrame:
    """Requests per key in the moving minute up to each one, and whether it is over the limit."""
    timed = requests.select("key", paid.alias("paid"), F.unix_micros("ts").alias("happened"))
    out = moving_count(timed, ["key", "paid"], "happened", 60_000_000)
    limit = F.when(F.col("paid"), PAID_RATE).otherwise(FREE_RATE)
    return out.withColumns({"limit": limit, "limited": F.col("hits") > limit})


def notify_targets(events: DataFrame, preferences: DataFrame) -> DataFrame:
    """Events (user_id, event) whose user wants them: own setting, else the default.

    preferences: (user_id, event, enabled), at most one row per user and event.
    """
    default = F.element_at(F.create_map(*[e for k, v in NOTIFY_DEFAULTS.items() for e in (F.lit(k), F.lit(v))]),
                           F.col("event"))
    joined = events.join(maybe_broadcast(preferences), ["user_id", "event"], "left")
    return joined.withColumn("notify", F.coalesce("enabled", default, F.lit(False))).drop("enabled")


def training_progress(phases: DataFrame, has_summary: Column) -> DataFrame:
    """Percent done per experiment from (experiment_id, phase, completed, current) rows."""
    weight = F.coalesce(F.try_element_at(
        F.create_map(*[e for k, v in PHASE_WEIGHTS.items() for e in (F.lit(k), F.lit(v))]), F.col("phase")), F.lit(10))
    part = F.when(F.col("completed"), weight).when(F.col("current"), weight * 0.5).otherwise(0.0)
    return phases.groupBy("experiment_id").agg(
        F.when(F.bool_or(has_summary), 100).otherwise(
            F.least(F.floor(F.sum(part)), F.lit(100))).cast("bigint").alias("progress"))


def parse_progress_log(logs: DataFrame, column: str = "log") -> DataFrame:
    """One row per non-blank line: `[time] text` split in two, any other line with an empty time."""
    lines = logs.select("*", F.posexplode(F.split(F.trim(column), "\n")).alias("line_no", "line")).where(
        F.trim("line") != "")
    stamped = F.col("line").startswith("[") & F.contains("line", F.lit("]"))
    return lines.select(
        *[c for c in logs.columns if c != column], "line_no",
        F.when(stamped, F.regexp_extract("line", r"^\[([^\]]*)\]", 1)).otherwise("").alias("timestamp"),
        F.when(stamped, F.regexp_replace("line", r"^\[[^\]]*\].?", "")).otherwise(F.col("line")).alias("message"))
