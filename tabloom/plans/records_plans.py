"""Bookkeeping queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tabloom.operators import insights, records
from tabloom.plans.frames import EXPERIMENTS, JOBS
from tabloom.plans.registry import Frame, query
from tabloom.session import load

NOW = datetime(1999, 6, 1)
NOW_SQL = "TIMESTAMP '1999-06-01 00:00:00'"

DATASETS = Frame("part", "p_partkey AS dataset_id", "concat(p_brand, '/', p_name, '.csv') AS file_path")
# datasets to delete: those of the smallest parts
DELETED = Frame("part", "p_partkey AS dataset_id", where="p_size <= 10")


@query("experiment_status", f"""WITH e AS ({EXPERIMENTS.sql}), j AS ({JOBS.sql})
SELECT e.id AS experiment_id, e.name, e.status AS experiment_status, j.model, j.status AS job_status, j.score
FROM e LEFT JOIN j ON e.id = j.experiment_id""")
def experiment_jobs(spark, d):
    return records.experiment_status(EXPERIMENTS(spark, d), JOBS(spark, d))


@query("list_completed_models", f"SELECT id, name, created_at FROM ({EXPERIMENTS.sql}) WHERE status = 'completed'")
def completed_models(spark, d):
    return records.list_completed_models(EXPERIMENTS(spark, d)).select("id", "name", "created_at")


@query("unshared_files", f"""WITH d AS ({DATASETS.sql}), x AS ({DELETED.sql})
SELECT DISTINCT file_path FROM d WHERE dataset_id IN (SELECT dataset_id FROM x)
 AND file_path NOT IN (SELECT file_path FROM d WHERE dataset_id NOT IN (SELECT dataset_id FROM x))""")
def files_to_delete(spark, d):
    return records.unshared_files(DATASETS(spark, d), DELETED(spark, d))


@query("cascade_delete", f"""WITH e AS ({EXPERIMENTS.sql}), j AS ({JOBS.sql}), x AS ({DELETED.sql}),
k AS (SELECT id AS experiment_id FROM e WHERE dataset_id NOT IN (SELECT dataset_id FROM x))
SELECT 'experiment' AS kind, experiment_id, CAST(NULL AS VARCHAR) AS model FROM k
UNION ALL SELECT 'job', experiment_id, model FROM j WHERE experiment_id IN (SELECT experiment_id FROM k)""")
def remaining_after_delete(spark, d):
    return records.cascade_delete(EXPERIMENTS(spark, d), JOBS(spark, d), DELETED(spark, d))


@query("concat_tables", """SELECT c_custkey AS "key", c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier""")
def parties(spark, d):
    c = load(spark, d, "customer").selectExpr("c_custkey AS key", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment")
    s = load(spark, d, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS key", "s_acctbal AS balance")
    return records.concat_tables(c, s)


PAYMENTS = Frame(
    "events", "event_id AS seq", "ts AS happened", "user_id",
    "concat(CAST(user_id AS VARCHAR(9)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS order_id",
    "concat(CAST(user_id AS VARCHAR(9)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(10)), '-', event_type) AS payment_id",
    "CASE event_type WHEN 'purchase' THEN 'captured' WHEN 'error' THEN 'failed' ELSE 'created' END AS status",
    "CAST(floor(value * 100) AS BIGINT) AS amount",
    "CASE WHEN value > 40 THEN 'advance' ELSE 'pro' END AS plan")
USERS = Frame("customer", "c_custkey AS user_id",
              "CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'AUTOMOBILE' THEN 'advance' ELSE 'free' END AS plan_type")


@query("billing_summary", f"""WITH p AS ({PAYMENTS.sql}), u AS ({USERS.sql}),
t AS (SELECT user_id, coalesce(sum(amount) FILTER (WHERE status = 'captured'), 0) AS s, count(*) FILTER (WHERE status = 'captured') AS n
 FROM p GROUP BY 1)
SELECT u.user_id, u.plan_type AS current_plan, CAST(coalesce(s, 0) AS BIGINT) AS total_spent, coalesce(n, 0) AS successful_payments,
 '₹' || format('{{:,.2f}}', coalesce(s, 0) / 100.0) AS total_spent_display FROM u LEFT JOIN t ON u.user_id = t.user_id""")
def billing(spark, d):
    return records.billing_summary(PAYMENTS(spark, d), USERS(spark, d))


@query("payment_upsert", f"""WITH p AS ({PAYMENTS.sql}), r AS (SELECT order_id, user_id, arg_max(payment_id, (happened, seq)) AS lp, arg_max(status, (happened, seq)) AS ls,
 arg_max(amount, (happened, seq)) AS la, max(happened) AS lt, bool_or(status = 'captured') AS c,
 arg_min(payment_id, (happened, seq)) FILTER (WHERE status = 'captured') AS cp,
 arg_min(amount, (happened, seq)) FILTER (WHERE status = 'captured') AS ca, min(happened) FILTER (WHERE status = 'captured') AS ct
 FROM p GROUP BY 1, 2)
SELECT order_id, user_id, coalesce(cp, lp) AS payment_id, CASE WHEN c THEN 'captured' ELSE ls END AS status,
 coalesce(ca, la) AS amount, coalesce(ct, lt) AS applied_at FROM r""")
def latest_payments(spark, d):
    return records.payment_upsert(PAYMENTS(spark, d))


@query("plan_expiry_fold", f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY happened, seq) AS k,
 CASE plan WHEN 'advance' THEN 365 ELSE 30 END AS days FROM ({PAYMENTS.sql}) WHERE status = 'captured'),
f AS (SELECT user_id, k, plan, happened + to_days(days) AS e FROM p WHERE k = 1
 UNION ALL SELECT p.user_id, p.k, p.plan, greatest(p.happened, f.e) + to_days(p.days) FROM f JOIN p ON p.user_id = f.user_id AND p.k = f.k + 1)
SELECT user_id, max(k) AS payments, max(e) AS plan_expires_at, arg_max(plan, k) AS plan_type FROM f GROUP BY 1""")
def plan_ends(spark, d):
    return records.plan_expiry_fold(PAYMENTS(spark, d).where("status = 'captured'"), ["happened", "seq"])


MEMBERS_SQL = f"""SELECT user_id, plan_type, max(o_orderdate) + INTERVAL 365 DAY AS plan_expires_at
 FROM ({USERS.sql}) JOIN orders ON user_id = o_custkey GROUP BY 1, 2"""


def members(spark, d):
    last = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        (F.max("o_orderdate") + F.expr("INTERVAL 365 DAY")).alias("plan_expires_at"))
    return USERS(spark, d).join(last, "user_id")


@query("expired_plans", f"""SELECT user_id, 'free' AS plan_type, plan_expires_at FROM ({MEMBERS_SQL})
 WHERE plan_type IN ('pro', 'advance') AND plan_expires_at < {NOW_SQL}""")
def downgraded(spark, d):
    return records.expired_plans(members(spark, d), NOW)


@query("is_pro_active", f"""SELECT user_id, plan_type IN ('pro', 'advance') AND NOT (plan_expires_at < {NOW_SQL}) AS active FROM ({MEMBERS_SQL})""")
def pro_users(spark, d):
    return members(spark, d).select(
        "user_id", records.is_pro_active(F.col("plan_type"), F.col("plan_expires_at"), NOW).alias("active"))


RUNS = Frame("events", "user_id", "ts AS created_at", "event_id", where="event_type = 'click'")


@query("quota_24h", f"""WITH t AS (SELECT user_id, epoch_us(created_at) // 1000000 AS second FROM ({RUNS.sql})),
c AS (SELECT user_id, second, count(*) AS n FROM t GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS r FROM c)
SELECT user_id, CAST(second AS BIGINT) AS second, n, CAST(r AS BIGINT) AS runs_24h, r - n >= 1 AS blocked FROM w""")
def run_quota(spark, d):
    return records.quota_24h(RUNS(spark, d))


@query("dataset_quota", """SELECT user_id, count(*) AS datasets, count(*) >= 3 AS blocked FROM events WHERE event_type = 'click' GROUP BY 1""")
def upload_quota(spark, d):
    return records.dataset_quota(RUNS(spark, d))


@query("rate_limit_hits", """WITH t AS (SELECT user_id % 3 AS key, event_type = 'purchase' AS paid, epoch_us(ts) AS happened FROM events),
c AS (SELECT key, paid, happened, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY key, paid ORDER BY happened RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS h FROM c)
SELECT CAST(key AS BIGINT) AS key, paid, happened, n, CAST(h AS BIGINT) AS hits, CASE WHEN paid THEN 200 ELSE 20 END AS "limit",
 h > CASE WHEN paid THEN 200 ELSE 20 END AS limited FROM w""")
def limited_requests(spark, d):
    r = load(spark, d, "events").select((F.col("user_id") % 3).cast("bigint").alias("key"), "ts", "event_type")
    return records.rate_limit_hits(r, F.col("event_type") == "purchase")


NOTICES = Frame("events", "event_id", "user_id",
                "CASE event_type WHEN 'purchase' THEN 'billing_updates' WHEN 'error' THEN 'training_failed'"
                " WHEN 'signup' THEN 'product_updates' WHEN 'view' THEN 'weekly_report' ELSE 'api_rate_limit' END AS event")
SETTINGS = Frame("customer", "c_custkey AS user_id", "CASE c_mktsegment WHEN 'BUILDING' THEN 'billing_updates'"
                 " WHEN 'MACHINERY' THEN 'weekly_report' ELSE 'training_failed' END AS event", "c_acctbal > 4000 AS enabled")


@query("notify_targets", f"""WITH e AS ({NOTICES.sql}), s AS ({SETTINGS.sql})
SELECT e.event_id, e.user_id, e.event, coalesce(s.enabled, e.event IN ('billing_updates', 'training_failed', 'api_rate_limit')) AS notify
FROM e LEFT JOIN s ON e.user_id = s.user_id AND e.event = s.event""")
def who_to_notify(spark, d):
    return records.notify_targets(NOTICES(spark, d), SETTINGS(spark, d))


PHASES = Frame("lineitem", "l_orderkey AS experiment_id",
               "CASE l_linenumber WHEN 1 THEN 'preprocessing' WHEN 2 THEN 'feature_engineering' WHEN 3 THEN 'model_development'"
               " WHEN 4 THEN 'evaluation' WHEN 5 THEN 'ready' ELSE 'extra' END AS phase",
               "l_linestatus = 'F' AS completed", "l_returnflag = 'R' AS current", "l_quantity = 50 AS summary")


@query("training_progress", f"""WITH p AS ({PHASES.sql}), w AS (SELECT *, CASE phase WHEN 'preprocessing' THEN 15 WHEN 'feature_engineering' THEN 15
 WHEN 'model_development' THEN 40 WHEN 'evaluation' THEN 20 ELSE 10 END AS weight FROM p)
SELECT experiment_id, CAST(CASE WHEN bool_or(summary) THEN 100 ELSE least(floor(sum(CASE WHEN completed THEN weight
 WHEN current THEN weight * 0.5 ELSE 0 END)), 100) END AS BIGINT) AS progress FROM w GROUP BY 1""")
def progress(spark, d):
    return records.training_progress(PHASES(spark, d), F.col("summary"))


@query("trust_summary", """WITH t AS (SELECT l_orderkey, CAST(sum(l_quantity) * 10 AS BIGINT) AS data_size FROM lineitem GROUP BY 1),
s AS (SELECT *, data_size - (data_size + 4) // 5 AS train_size, (data_size + 4) // 5 AS test_size FROM t)
SELECT l_orderkey, data_size, train_size, test_size, CAST(CAST(round_even(train_size * 100.0 / data_size, 0) AS INTEGER) AS VARCHAR) || '%' AS train_ratio,
 CAST(CAST(round_even(test_size * 100.0 / data_size, 0) AS INTEGER) AS VARCHAR) || '%' AS test_ratio,
 CASE WHEN data_size >= 1000 THEN 'high' ELSE 'medium' END AS confidence,
 CASE WHEN data_size >= 1000 THEN 'Trained on a substantial dataset' WHEN data_size >= 500 THEN 'Trained on a moderate dataset'
 ELSE 'Limited training data available' END AS size_reason FROM s""")
def trust(spark, d):
    t = load(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") * 10).cast("bigint").alias("data_size"))
    test = F.floor((F.col("data_size") + 4) / 5)
    return insights.trust_summary(t.withColumns({"train_size": F.col("data_size") - test, "test_size": test}))


LOGS = Frame("conversations", "conv_id", "turn",
             "concat('[', CAST(turn AS VARCHAR(9)), ':00:00] ', role, chr(10), text) AS log")


@query("parse_progress_log", f"""WITH l AS (SELECT conv_id, turn, string_split(trim(log), chr(10)) AS parts FROM ({LOGS.sql})),
x AS (SELECT conv_id, turn, unnest(range(len(parts))) AS k, parts FROM l), y AS (SELECT conv_id, turn, k AS line_no, parts[k + 1] AS line FROM x)
SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no,
 CASE WHEN line LIKE '[%' AND contains(line, ']') THEN substr(line, 2, strpos(line, ']') - 2) ELSE '' END AS "timestamp",
 CASE WHEN line LIKE '[%' AND contains(line, ']') THEN substr(line, strpos(line, ']') + 2) ELSE line END AS message
FROM y WHERE trim(line) <> ''""")
def log_lines(spark, d):
    return records.parse_progress_log(LOGS(spark, d))
