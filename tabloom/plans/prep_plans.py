"""Preprocessing and splitting queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.functions.cells import row_hash, tidy
from tabloom.operators import prep, sampling
from tabloom.plans.frames import PEOPLE
from tabloom.plans.registry import Frame, query
from tabloom.session import load

T = f"WITH t AS ({PEOPLE.sql}) "
MED = "(SELECT quantile_cont(balance, 0.5) FROM t)"

SPARSE = Frame("events", "event_id", "CASE WHEN value < 20 THEN value END AS kept",
               "CASE WHEN value > 40 THEN value END AS rare", "CASE WHEN event_type = 'error' THEN user_id END AS gone")


def drop_high_sql() -> str:
    names = ["event_id", "kept", "rare", "gone"]
    return f"WITH t AS ({SPARSE.sql}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(1 - count({c}) / count(*), 6) AS missing_ratio, 1 - count({c}) / count(*) <= 0.6 AS kept FROM t"""
        for c in names)


@query("drop_high_missing", drop_high_sql())
def kept_columns(spark, d):
    t = SPARSE(spark, d)
    kept = prep.drop_high_missing(t).columns
    return prep.missing_ratios(t).select(
        "column", tidy(F.col("missing_ratio")).alias("missing_ratio"), F.col("column").isin(kept).alias("kept"))


@query("identify_columns", T + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, CASE WHEN {num} AND NOT (count(DISTINCT {c}) <= 10
 AND count(DISTINCT {c}) < count(*) * 0.05) THEN 'numeric' ELSE 'categorical' END AS kind FROM t"""
    for c, num in (("customer_id", "true"), ("nation", "true"), ("segment", "false"), ("balance", "true"), ("hobby", "false"),
                   ("k", "true"), ("active", "false"))))
def column_kinds(spark, d):
    return prep.identify_columns(PEOPLE(spark, d))


@query("impute_numeric", T + f"SELECT customer_id, round(coalesce(balance, {MED}), 6) AS balance FROM t")
def filled_balance(spark, d):
    t = PEOPLE(spark, d).select("customer_id", "balance")
    out = prep.impute_numeric(t, prep.fit_fill(t, ["balance"]))
    return out.withColumn("balance", tidy(F.col("balance")))


@query("impute_mode", T + """SELECT customer_id, coalesce(hobby, (SELECT hobby FROM t WHERE hobby IS NOT NULL GROUP BY hobby
 ORDER BY count(*) DESC, hobby LIMIT 1)) AS hobby FROM t""")
def filled_hobby(spark, d):
    t = PEOPLE(spark, d).select("customer_id", "hobby")
    return prep.impute_mode(t, prep.fit_mode(t, ["hobby"]))


@query("missing_indicators", T + "SELECT customer_id, CAST(balance IS NULL AS DOUBLE) AS missing_balance FROM t")
def balance_gaps(spark, d):
    t = PEOPLE(spark, d).select("customer_id", "balance")
    return prep.missing_indicators(t, prep.columns_with_nulls(t, ["customer_id", "balance"])).drop("balance")


@query("robust_scale", T + """, q AS (SELECT quantile_cont(balance, 0.5) AS m, quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25) AS r FROM t)
SELECT customer_id, round((balance - m) / r, 6) + 0.0 AS balance, 0.0::DOUBLE AS k FROM t, q""")
def robust_balance(spark, d):
    t = PEOPLE(spark, d).select("customer_id", "balance", "k")
    out = prep.scale(t, prep.fit_robust(t, ["balance", "k"]))
    return out.withColumn("balance", tidy(F.col("balance")))


@query("standard_scale", T + """, q AS (SELECT avg(balance) AS m, stddev_pop(balance) AS s FROM t)
SELECT customer_id, round((balance - m) / s, 6) + 0.0 AS balance, 0.0::DOUBLE AS k FROM t, q""")
def standard_balance(spark, d):
    t = PEOPLE(spark, d).select("customer_id", "balance", "k")
    out = prep.scale(t, prep.fit_standard(t, ["balance", "k"]))
    return out.withColumn("balance", tidy(F.col("balance")))


@query("inverse_scale", T + "SELECT customer_id, balance FROM t")
def unscaled_balance(spark, d):
    t = PEOPLE(spark, d).select("customer_id", "balance")
    fitted = prep.fit_robust(t, ["balance"])
    return prep.inverse_scale(prep.scale(t, fitted), fitted).withColumn("balance", tidy(F.col("balance")))


@query("drop_constant", T + "SELECT customer_id, balance FROM t")
def varying_columns(spark, d):
    t = PEOPLE(spark, d).select("customer_id", "balance", "k")
    return prep.drop_constant(t, ["customer_id", "balance", "k"])


@query("ordinal_encode", """WITH c AS (SELECT p_name AS v, row_number() OVER (ORDER BY p_name) - 1 AS code FROM part WHERE p_size > 10 GROUP BY 1)
SELECT p_partkey, coalesce(code, 0) AS p_name FROM part LEFT JOIN c ON p_name = v""")
def coded_names(spark, d):
    # fitted on the larger parts; a name seen only among the smaller ones becomes class 0
    t = load(spark, d, "part").select("p_partkey", "p_name", "p_size")
    fitted = prep.category_dictionary(t.where("p_size > 10"), ["p_name"])
    return prep.ordinal_encode(t.select("p_partkey", "p_name"), ["p_name"], fitted)


@query("label_encode_target", """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders""")
def coded_priority(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return prep.ordinal_encode(t, ["o_orderpriority"], prep.category_dictionary(t, ["o_orderpriority"]), unseen=None)


@query("decode_target", "SELECT o_orderkey, o_orderpriority FROM orders")
def decoded_priority(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    dictionary = prep.category_dictionary(t, ["o_orderpriority"])
    coded = prep.ordinal_encode(t, ["o_orderpriority"], dictionary, unseen=None)
    return prep.decode(coded, "o_orderpriority", dictionary, "o_orderpriority")


@query("one_hot", """SELECT o_orderkey, (SELECT string_agg(CASE WHEN v = o_orderpriority THEN '1' ELSE '0' END, '' ORDER BY v)
 FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)) AS bits FROM orders""")
def priority_bits(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    out = prep.one_hot(t, ["o_orderpriority"], prep.category_dictionary(t, ["o_orderpriority"]))
    bits = F.transform(vector_to_array("o_orderpriority_vec"), lambda x: x.cast("int").cast("string"))
    return out.select("o_orderkey", F.array_join(bits, "").alias("bits"))


@query("combined_preprocess", T + f""", c AS (SELECT coalesce(hobby, 'nan') AS v, row_number() OVER (ORDER BY coalesce(hobby, 'nan')) - 1 AS code FROM t GROUP BY 1),
f AS (SELECT customer_id, c.code AS hobby, coalesce(balance, {MED}) AS filled, coalesce(balance, 0) AS zeroed FROM t JOIN c ON coalesce(t.hobby, 'nan') = c.v),
s AS (SELECT avg(hobby) AS hm, stddev_pop(hobby) AS hs, avg(filled) AS bm, stddev_pop(filled) AS bs FROM f)
SELECT customer_id, round((hobby - hm) / hs, 6) + 0.0 AS hobby, round((zeroed - bm) / bs, 6) + 0.0 AS balance, round((filled - bm) / bs, 6) + 0.0 AS fit_balance FROM f, s""")
def combined(spark, d):
    t = PEOPLE(spark, d).select("customer_id", "hobby", "balance")
    model = prep.CombinedModel.fit(t.drop("customer_id"))
    later = model.transform(t)
    fitted = model.fit_rows(t).select("customer_id", F.col("balance").alias("fit_balance"))
    out = later.join(fitted, "customer_id")
    return out.select("customer_id", *[tidy(F.col(c)).alias(c) for c in ("hobby", "balance", "fit_balance")])


FEATURES = ["nation", "segment", "balance", "hobby", "k"]


@query("preprocess_pipeline")
def people_vectors(spark, d):
    t = PEOPLE(spark, d)
    return prep.TabularPreprocessor(inputCols=FEATURES).fit(t).transform(t).select("customer_id", vector_to_array("features").alias("x"))


@query("preprocessing_info")
def people_prep_info(spark, d):
    return prep.preprocessing_info(prep.TabularPreprocessor(inputCols=FEATURES).fit(PEOPLE(spark, d)), spark)


@query("align_features", T + "SELECT 0 AS extra, coalesce(balance, 0) AS balance, customer_id FROM t")
def aligned(spark, d):
    return prep.align_and_fill(PEOPLE(spark, d), ["extra", "balance", "customer_id"])


# ---- splits ----

H = "md5(CAST(o_orderkey AS VARCHAR))"


@query("train_test_split", f"""SELECT o_orderkey, CASE WHEN CAST(('0x' || substr({H}, 1, 8)) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM orders""")
def split_orders(spark, d):
    return sampling.train_test_split(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("stratified_split", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}) AS k,
 count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN k <= round(n * 20 / 100.0) THEN 'test' ELSE 'train' END AS part FROM r""")
def split_by_status(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_split(t, "o_orderstatus", ["o_orderkey"])


@query("kfold_assign", f"""SELECT o_orderkey, o_orderstatus,
 CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}) - 1) % 5 AS INTEGER) AS fold FROM orders""")
def folds(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.kfold_assign(t, ["o_orderkey"], "o_orderstatus")


@query("generate_table")
def made_up(spark, d):
    ids = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return sampling.generate_table(ids, [
        {"name": "row", "type": "id", "prefix": "ROW"}, {"name": "price", "type": "numeric", "min": 5, "max": 9},
        {"name": "count", "type": "integer", "min": 1, "max": 6}, {"name": "colour", "type": "categorical", "categories": ["red", "green"]},
        {"name": "ok", "type": "boolean", "true_probability": 0.3}, {"name": "day", "type": "date"}, {"name": "note", "type": "text"}])


@query("extend_from_seed")
def more_customers(spark, d):
    return sampling.extend_from_seed(load(spark, d, "customer"), "c_custkey", ["c_acctbal"], ["c_mktsegment"], 2)
