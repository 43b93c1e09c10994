"""Explanation and prediction queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.functions.cells import tidy
from tabloom.operators import explain, headers, models, predict, treeshap
from tabloom.plans.frames import PEOPLE
from tabloom.plans.model_plans import TEXT_FEATURES, VALUE_FEATURES, class_table, fitted, value_table
from tabloom.plans.registry import Frame, query
from tabloom.session import load


@query("tree_importance")
def document_importance(spark, d):
    trained, _ = fitted(class_table(spark, d), "decision_tree", True)
    return explain.tree_importance(trained, TEXT_FEATURES, spark)


@query("permutation_importance")
def customer_permutation(spark, d):
    trained, test = fitted(value_table(spark, d), "linear_regression", False)
    return explain.permutation_importance(trained.score, test, VALUE_FEATURES, False)


# a linear model with known coefficients over the line items
COEF = {"l_quantity": 1500.0, "l_discount": -20000.0, "l_tax": 300.0}
LINE_IDS = Frame("lineitem", "concat(CAST(l_orderkey AS VARCHAR(12)), '-', CAST(l_partkey AS VARCHAR(12)), '-', CAST(l_suppkey AS VARCHAR(12)), '-', CAST(l_linenumber AS VARCHAR(3)),"
                 " '-', CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS VARCHAR(15))) AS id", "l_quantity", "l_discount", "l_tax")
PHI_SQL = f"""WITH t AS ({LINE_IDS.sql}), m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM t),
f AS (SELECT id, 'l_quantity' AS feature, l_quantity AS value, 1500.0 * (l_quantity - q) AS shap_value FROM t, m
 UNION ALL SELECT id, 'l_discount', l_discount, -20000.0 * (l_discount - d) FROM t, m UNION ALL SELECT id, 'l_tax', l_tax, 300.0 * (l_tax - x) FROM t, m)"""


def line_phi(spark, d):
    # a line listed twice is explained once
    return explain.shap_linear(LINE_IDS(spark, d), COEF)


@query("shap_linear", PHI_SQL + " SELECT id, feature, value, round(shap_value, 4) + 0.0 AS shap_value FROM f")
def linear_contributions(spark, d):
    return line_phi(spark, d).withColumn("shap_value", tidy(F.col("shap_value"), 4))


@query("global_importance", PHI_SQL + """, g AS (SELECT feature, avg(abs(shap_value)) AS v FROM f GROUP BY 1)
SELECT feature, round(v, 4) AS importance, round(v / sum(v) OVER (), 6) AS importance_normalized, CAST(row_number() OVER (ORDER BY v DESC) AS INTEGER) AS rank FROM g""")
def line_importance(spark, d):
    out = explain.global_importance(line_phi(spark, d))
    return out.withColumns({"importance": tidy(F.col("importance"), 4), "importance_normalized": tidy(F.col("importance_normalized"))})


ORDER_PHI_SQL = """WITH m AS (SELECT avg(o_totalprice) AS p, avg(o_custkey) AS c FROM orders),
f AS (SELECT o_orderkey AS id, 'o_totalprice' AS feature, o_totalprice AS value, round(0.001 * (o_totalprice - p), 6) + 0.0 AS shap_value FROM orders, m
 UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE), round(-0.25 * (o_custkey - c), 6) + 0.0 FROM orders, m),
e AS (SELECT *, CASE WHEN shap_value > 0 THEN 'positive' ELSE 'negative' END AS impact, abs(shap_value) AS abs_impact,
 CAST(row_number() OVER (PARTITION BY id ORDER BY abs(shap_value) DESC, feature) AS INTEGER) AS rank, round(sum(shap_value) OVER (PARTITION BY id), 6) + 0.0 AS prediction_offset FROM f)"""


def order_phi(spark, d):
    t = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return explain.shap_linear(t, {"o_totalprice": 0.001, "o_custkey": -0.25}).withColumn("shap_value", tidy(F.col("shap_value")))


@query("explain_rows", ORDER_PHI_SQL + " SELECT * FROM e")
def order_contributions(spark, d):
    return explain.explain_rows(order_phi(spark, d)).withColumn("prediction_offset", tidy(F.col("prediction_offset")))


@query("explanation_text", ORDER_PHI_SQL + """ SELECT id, 'The prediction was primarily influenced by:' || chr(10) || string_agg(rank || '. **' || feature || '** (value: '
 || format('{:.2f}', round(value, 2)) || ') ' || CASE WHEN shap_value > 0 THEN 'increased' ELSE 'decreased' END || ' the prediction by ' || format('{:.4f}', round(abs_impact, 4)), chr(10) ORDER BY rank) AS text FROM e GROUP BY 1""")
def order_sentences(spark, d):
    return explain.explanation_text(order_phi(spark, d))


@query("shap_sampled")
def customer_shapley(spark, d):
    trained, test = fitted(value_table(spark, d), "decision_tree", False)
    return explain.shap_sampled(trained.score, F.col("prediction"), test, VALUE_FEATURES)


@query("tree_shap")
def customer_tree_shap(spark, d):
    trained, test = fitted(value_table(spark, d), "decision_tree", False)
    return explain.shap_values(trained, test, VALUE_FEATURES, F.col("prediction"))


@query("tree_shap_classes")
def document_tree_shap(spark, d):
    trained, test = fitted(class_table(spark, d), "random_forest", True)
    return explain.shap_values(trained, test, TEXT_FEATURES, F.col("probability")[1])


# a pricing rule over the line items: (left, right, feature, threshold) or a value; node weights are counted from the table
RULE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
RULE = {0: (1, 2, 0, 25.0), 1: (3, 4, 1, 0.05), 2: (5, 6, 2, 0.04), 3: 10.0, 4: (7, 8, 0, 12.0), 5: 30.0, 6: (9, 10, 1, 0.03), 7: 18.0, 8: 25.0, 9: 41.0, 10: 60.0}
RULE_NODES = {k: treeshap.Node(0.0, np.array([n])) if isinstance(n, float) else treeshap.Node(0.0, np.zeros(1), *n) for k, n in RULE.items()}


def _reach(at: int) -> str:
    """The condition under which a row comes to a node."""
    for k, n in RULE.items():
        if not isinstance(n, float) and at in n[:2]:
            return f"({_reach(k)} AND {RULE_FEATURES[n[2]]} {'<=' if at == n[0] else '>'} {n[3]}::DOUBLE)"
    return "true"


def _expected(at: int, known: frozenset[int]) -> str:
    """The tree's value below a node if the features in `known` are followed and the others averaged."""
    n = RULE[at]
    if isinstance(n, float):
        return f"{n}::DOUBLE"
    a, b = _expected(n[0], known), _expected(n[1], known)
    if n[2] in known:
        return f"(CASE WHEN {RULE_FEATURES[n[2]]} <= {n[3]}::DOUBLE THEN {a} ELSE {b} END)"
    return f"((n{n[0]} * {a} + n{n[1]} * {b}) / n{at})"


def _rule_phi(i: int) -> str:
    """A Shapley value by its definition, over all sets of the other two features."""
    a, b = (j for j in range(3) if j != i)
    terms = [(2, ()), (1, (a,)), (1, (b,)), (2, (a, b))]
    return " + ".join(f"{w} / 6.0 * ({_expected(0, frozenset((*s, i)))} - {_expected(0, frozenset(s))})" for w, s in terms)


RULE_SQL = f"""WITH n AS (SELECT {", ".join(f"CAST(count(*) FILTER ({_reach(k)}) AS DOUBLE) AS n{k}" for k in RULE)} FROM lineitem),
t AS (SELECT {LINE_IDS.exprs[0]}, l_quantity, l_discount, l_tax, {", ".join(f"{_rule_phi(i)} AS p{i}" for i in range(3))} FROM lineitem, n)
""" + " UNION ALL ".join(f"SELECT id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, round(p{i}, 6) + 0.0 AS shap_value FROM t" for i, c in enumerate(RULE_FEATURES))


@query("tree_shap_rule", RULE_SQL)
def line_tree_shap(spark, d):
    t = LINE_IDS(spark, d)
    trees = treeshap.Trees.given([treeshap.weighed(RULE_NODES, t, RULE_FEATURES)])
    phi = treeshap.tree_shap(t, trees, RULE_FEATURES, features=F.array(*[F.col(c).cast("double") for c in RULE_FEATURES]))
    return phi.withColumn("shap_value", tidy(F.col("shap_value"), 6))


@query("predict_explain")
def customer_explained(spark, d):
    trained, test = fitted(value_table(spark, d), "decision_tree", False)
    return explain.predict_explain(trained, test, VALUE_FEATURES, F.col("prediction"))


# ---- prediction ----

@query("batch_predict")
def document_batch(spark, d):
    trained, test = fitted(class_table(spark, d), "logistic_regression", True)
    return predict.batch_predict(trained, test, ["low", "high"], order="id")


@query("batch_predict_line", """WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b FROM orders)
SELECT o_orderkey AS id, round(round_even(a * o_custkey + b, 4), 2) AS prediction, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders, m""")
def orders_batch(spark, d):
    t = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("label"),
                                        array_to_vector(F.array(F.col("o_custkey").cast("double"))).alias("features"))
    out = predict.batch_predict(models.fit_linear(t, {}), t, order="id")
    return out.select("id", tidy(F.col("prediction"), 2).alias("prediction"), "row_index")


RAW = Frame("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "CAST(l_linenumber AS DOUBLE) - 2 AS prediction", "l_extendedprice / 7 AS value")


@query("decode_prediction", f"""SELECT l_orderkey, l_partkey, l_suppkey, CASE prediction WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue'
 ELSE CAST(CAST(prediction AS INTEGER) AS VARCHAR) END AS decoded, round_even(value, 4) AS rounded FROM ({RAW.sql})""")
def decoded_lines(spark, d):
    return RAW(spark, d).select("l_orderkey", "l_partkey", "l_suppkey",
                                predict.decode_prediction(F.col("prediction"), ["red", "green", "blue"]).alias("decoded"),
                                predict.round_prediction(F.col("value")).alias("rounded"))


SHARES = Frame("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity / 101 AS a", "l_discount * 3.7 AS b")


def shares(spark, d):
    return SHARES(spark, d).withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")}).withColumn(
        "probability", F.array(F.col("a"), F.col("b"), F.lit(0.123)))


@query("confidence", f"""SELECT l_orderkey, l_partkey, l_suppkey, round(greatest(a, b, 0.123), 4) AS confidence, round(greatest(a, b, 0.123) * 100, 1) AS percent
FROM (SELECT l_orderkey, l_partkey, l_suppkey, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM ({SHARES.sql}))""")
def line_confidence(spark, d):
    return shares(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", predict.confidence(F.col("probability")).alias("confidence"),
                                   predict.confidence_percent(F.col("probability")).alias("percent"))


@query("class_probabilities", f"""WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM ({SHARES.sql}))
SELECT l_orderkey, l_partkey, l_suppkey, round(greatest(a, b, 0.123), 6) AS p1, CASE WHEN a >= b AND a >= 0.123 THEN 'a' WHEN b >= 0.123 THEN 'b' ELSE 'c' END AS c1,
 round(least(a, b, 0.123), 6) AS p3 FROM t""")
def ranked_classes(spark, d):
    r = predict.class_probabilities(shares(spark, d), ["a", "b", "c"])
    return r.select("l_orderkey", "l_partkey", "l_suppkey", tidy(F.col("ranked")[0]["p"]).alias("p1"), F.col("ranked")[0]["class"].alias("c1"),
                    tidy(F.col("ranked")[2]["p"]).alias("p3"))


@query("input_range_check", f"""WITH t AS ({PEOPLE.sql}), k AS (SELECT * FROM t WHERE active),
s AS (SELECT CAST(min(balance) AS DOUBLE) AS bl, CAST(max(balance) AS DOUBLE) AS bh, CAST(min(customer_id) AS DOUBLE) AS cl, CAST(max(customer_id) AS DOUBLE) AS ch FROM k)
SELECT customer_id, 'balance' AS "column", balance AS value, bl AS "min", bh AS "max" FROM t, s WHERE balance < bl OR balance > bh
UNION ALL SELECT customer_id, 'customer_id', CAST(customer_id AS DOUBLE), cl, ch FROM t, s WHERE customer_id < cl OR customer_id > ch""")
def out_of_range(spark, d):
    t = PEOPLE(spark, d)
    schema = headers.feature_schema(t.where("active").select("customer_id", "balance", "active"), "active")
    return predict.input_range_check(t, schema, "customer_id", ["customer_id", "balance"])


@query("category_codes", f"""WITH t AS ({PEOPLE.sql}), c AS (SELECT hobby, row_number() OVER (ORDER BY hobby) - 1 AS code FROM t WHERE hobby IS NOT NULL GROUP BY 1)
SELECT customer_id, coalesce(code, -1) AS hobby FROM t LEFT JOIN c ON t.hobby = c.hobby""")
def hobby_codes(spark, d):
    return predict.category_codes(PEOPLE(spark, d).select("customer_id", "hobby"), ["hobby"])


