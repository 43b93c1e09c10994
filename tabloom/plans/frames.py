"""Input frames derived from the given tables."""

from tabloom.plans.registry import Frame

# mixed types, missing values, a constant; one row per customer
PEOPLE = Frame(
    "customer",
    "c_custkey AS customer_id",
    "c_nationkey AS nation",
    "c_mktsegment AS segment",
    "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance",
    "CASE WHEN c_nationkey < 20 THEN c_mktsegment END AS hobby",
    "CAST(5 AS DOUBLE) AS k",
    "c_acctbal > 5000 AS active",
)

# one series per event type; readings above the sensor limit are missing
READINGS = Frame(
    "events",
    "event_id",
    "ts",
    "event_type AS series",
    "CASE WHEN value < 20 THEN value END AS value",
    "value AS raw",
)

# repeated rows arise by themselves: same user, kind and day
VISITS = Frame("events", "user_id", "event_type", "CAST(ts AS DATE) AS day")

# labelled documents are joined in the plans that need a class target
LINES = Frame(
    "lineitem",
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)

# experiments: one per order
EXPERIMENTS = Frame(
    "orders",
    "o_orderkey AS id",
    "o_custkey AS user_id",
    "o_custkey % 50 AS dataset_id",
    "concat(o_orderpriority, ' run ', CAST(o_orderkey AS VARCHAR(20))) AS name",
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status",
    "CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 600000 END AS best_score",
    "CASE WHEN o_totalprice > 100000 THEN 'classification' WHEN o_totalprice > 50000 THEN 'regression' END"
    " AS problem_type",
    "CASE WHEN o_totalprice > 200000 THEN concat('pkg/', CAST(o_orderkey AS VARCHAR(20))) END AS package_path",
    "o_orderdate AS created_at",
)

# training jobs: the lines of an order
JOBS = Frame(
    "lineitem",
    "l_orderkey AS experiment_id",
    "l_linenumber AS position",
    "concat('model_', CAST(l_linenumber AS VARCHAR(5)), '_', l_returnflag) AS model",
    "CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'running' END AS status",
    "l_extendedprice / 105000 AS score",
    "l_partkey AS run_key",
    "l_suppkey AS feature_key",
    "l_discount AS importance",
)
