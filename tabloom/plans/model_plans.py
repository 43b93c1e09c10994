"""Training, voting, neighbour and clustering queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.cells import tidy
from tabloom.operators import automl, cluster, models, neighbors, prep, sampling
from tabloom.plans.registry import Frame, query
from tabloom.session import load

TEXT_FEATURES = ["n_chars", "words", "lines", "upper_share", "letters_per_word", "foreign"]
VALUE_FEATURES = ["orders", "mean_price", "nation", "balance"]


def document_features(spark, d) -> DataFrame:
    """(id, label, features) of the labelled documents, from their whole text."""
    docs = load(spark, d, "documents")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    feats = docs.select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"), (upper / F.greatest(F.length("text"), F.lit(1))).alias("upper_share"),
        (F.col("n_chars") / F.greatest(words, F.lit(1))).alias("letters_per_word"), (F.col("lang") != "en").cast("double").alias("foreign"))
    labels = load(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label"))
    return feats.join(labels, "id")


def class_table(spark, d) -> DataFrame:
    # a few numbers per document; reading the texts again for every pass would cost far more
    t = document_features(spark, d).persist()
    t = prep.scale(t, prep.fit_standard(t, TEXT_FEATURES))
    return t.select("id", "label", array_to_vector(F.array(*TEXT_FEATURES)).alias("features"))


def value_columns(spark, d) -> DataFrame:
    """(id, label, columns) per customer: the target is the total of its orders."""
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("mean_price"), F.sum("o_totalprice").alias("label"))
    c = load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_acctbal").alias("balance"))
    return o.join(c, "id")


def value_table(spark, d) -> DataFrame:
    t = value_columns(spark, d).persist()
    t = prep.scale(t, prep.fit_standard(t, VALUE_FEATURES))
    return t.select("id", "label", array_to_vector(F.array(*VALUE_FEATURES)).alias("features"))


def fitted(table: DataFrame, name: str, classify: bool) -> tuple[models.Trained, DataFrame]:
    """A registry model trained on the train part, and the test part."""
    split = automl.prepare_split(table, classify)
    entry = (models.CLASSIFIERS if classify else models.REGRESSORS)[name]
    train = models.packed(split.where("part = 'train'").drop("part"))
    return entry.fit(train, dict(entry.params)), split.where("part = 'test'").drop("part")


def _register(key: str, name: str, classify: bool) -> None:
    @query(key)
    def run(spark, d, name=name, classify=classify):
        trained, test = fitted(class_table(spark, d) if classify else value_table(spark, d), name, classify)
        out = trained.score(test)
        return out.select("id", "label", "prediction")


for _key, _name, _cls in [
    ("train_logistic", "logistic_regression", True), ("train_random_forest_cls", "random_forest", True),
    ("train_gbt_cls", "gradient_boosting", True), ("train_kernel_svm", "svm", True),
    ("train_decision_tree_cls", "decision_tree", True), ("train_adaboost_cls", "adaboost", True),
    ("train_extra_trees_cls", "extra_trees", True), ("train_random_forest_reg", "random_forest", False),
    ("train_gbt_reg", "gradient_boosting", False), ("train_kernel_svr", "svr", False),
    ("train_decision_tree_reg", "decision_tree", False), ("train_adaboost_reg", "adaboost", False),
    ("train_extra_trees_reg", "extra_trees", False), ("train_ridge", "ridge", False),
    ("train_lasso", "lasso", False), ("train_elasticnet", "elasticnet", False),
]:
    _register(_key, _name, _cls)


@query("train_linear", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""")
def price_line(spark, d):
    t = load(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("label"), array_to_vector(F.array("l_quantity")).alias("features"))
    m = models.fit_linear(t, {}).model
    return spark.range(1).select(tidy(F.lit(float(m.coefficients[0])), 4).alias("slope"), tidy(F.lit(float(m.intercept)), 3).alias("intercept"))


_LINE_SQL = """WITH t AS (SELECT l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem),
s AS (SELECT covar_pop(x, y) AS xy, var_pop(x) AS xx, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM t), b AS (SELECT *, {slope} AS slope FROM s)
SELECT round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept FROM b"""


def _one_feature(key: str, name: str, slope: str) -> None:
    """One feature has a closed form under every penalty."""

    @query(key, _LINE_SQL.format(slope=slope))
    def run(spark, d, name=name):
        t = load(spark, d, "lineitem").select(
            (F.col("l_extendedprice") / 10000).alias("label"), array_to_vector(F.array(F.col("l_quantity") / 10)).alias("features"))
        entry = models.REGRESSORS[name]
        m = entry.fit(t, dict(entry.params)).model
        return spark.range(1).select(tidy(F.lit(float(m.coefficients[0])), 4).alias("slope"), tidy(F.lit(float(m.intercept)), 3).alias("intercept"))


_one_feature("ridge_line", "ridge", "xy / (xx + 1.0 / n)")
_one_feature("lasso_line", "lasso", "sign(xy) * greatest(abs(xy) - 1.0, 0) / xx")
_one_feature("elasticnet_line", "elasticnet", "sign(xy) * greatest(abs(xy) - 0.5, 0) / (xx + 0.5)")


QUICK = {"n_estimators": 5, "max_depth": 4}


@query("automl_classify")
def classify_documents(spark, d):
    return automl.automl(class_table(spark, d), True)[0]


@query("automl_regress")
def regress_customers(spark, d):
    return automl.automl(value_table(spark, d), False, ["linear_regression", "ridge", "lasso", "elasticnet", "decision_tree"])[0]


@query("automl_holdout")
def holdout_documents(spark, d):
    return automl.automl(class_table(spark, d), True, folds=None, config=QUICK)[0]


@query("automl_balanced")
def balanced_training(spark, d):
    return automl.automl(class_table(spark, d), True, ["logistic_regression", "decision_tree"], None, balance=True)[0]


@query("config_overrides")
def configured(spark, d):
    return automl.automl(class_table(spark, d), True, ["random_forest"], None, {"n_estimators": 7, "max_depth": 3})[0]


@query("ensemble_top3")
def best_three(spark, d):
    t = value_table(spark, d)
    board, trained = automl.automl(t, False, ["linear_regression", "ridge", "decision_tree", "lasso"], None)
    return automl.ensemble_top3(t, False, board, trained)


@query("embedding_head")
def embedding_classes(spark, d):
    t = embedding_split(spark, d)
    head = models.fit_embedding_head(t.where("part = 'train'").drop("part"))
    return head.score(t.where("part = 'test'")).select("id", "label", "prediction")


# ---- neighbours ----

EMB_SQL = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS DOUBLE) AS label,
 CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM embeddings),
n AS (SELECT q.id AS qid, p.id AS pid, p.label, list_distance(q.v, p.v) AS distance,
 row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, p.v), p.id) AS rank FROM e q, e p WHERE q.part = 'test' AND p.part = 'train' QUALIFY rank <= 5)"""


def embedding_rows(spark, d):
    return load(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("label"))


def embedding_split(spark, d):
    t = sampling.train_test_split(embedding_rows(spark, d), ["id"])
    return t.withColumn("features", array_to_vector("v")).select("id", "features", "label", "part")


@query("knn_join", f"WITH {EMB_SQL} SELECT qid, pid, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM n")
def nearest_embeddings(spark, d):
    t = sampling.train_test_split(embedding_rows(spark, d), ["id"])
    out = neighbors.knn_join(t.where("part = 'test'"), t.where("part = 'train'"), 5)
    return out.withColumn("distance", tidy(F.col("distance")))


@query("train_knn_cls", f"""WITH {EMB_SQL}, c AS (SELECT qid, label, count(*) AS k FROM n GROUP BY 1, 2)
SELECT qid AS id, arg_max(label, (k, -label)) AS prediction FROM c GROUP BY 1""")
def knn_classes(spark, d):
    t = embedding_split(spark, d)
    m = models.fit_knn_classifier(t.where("part = 'train'").drop("part"), {"n_neighbors": 5})
    return m.score(t.where("part = 'test'").drop("part")).select("id", "prediction")


@query("train_knn_reg", f"WITH {EMB_SQL} SELECT qid AS id, round(avg(label), 6) AS prediction FROM n GROUP BY 1")
def knn_values(spark, d):
    t = embedding_split(spark, d)
    m = models.fit_knn_regressor(t.where("part = 'train'").drop("part"), {"n_neighbors": 5})
    return m.score(t.where("part = 'test'").drop("part")).select("id", tidy(F.col("prediction")).alias("prediction"))


@query("smote")
def balanced_documents(spark, d):
    return sampling.smote(document_features(spark, d), "id", "label", TEXT_FEATURES)


# ---- votes: three models' class shares per line item, derived from its columns ----

VOTES = Frame("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity / 100 AS a", "l_discount * 5 AS b", "l_tax * 8 AS c")
VOTE_ID = "row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, a, b, c)"


def vote_rows(spark, d):
    """Per line the class shares of three made-up models, as (model, id, probability)."""
    t = VOTES(spark, d).withColumn("id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "a", "b", "c"))
    arr = [F.array(1 - F.col(x), F.col(x) * 0.5, F.col(x) * 0.5) for x in ("a", "b", "c")]
    t = automl.dealt(t, "id", load(spark, d, "lineitem").count()).groupBy("id").agg(*[F.first(x).alias(x) for x in ("a", "b", "c")])
    return t.select("id", *[x.alias(f"m{i}") for i, x in enumerate(arr)]).select("id", F.explode(F.array(*[
        F.struct(F.lit(f"m{i}").alias("model"), F.col(f"m{i}").alias("probability")) for i in range(3)])).alias("s")).select("id", "s.*")


_ID_SQL = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || a || '-' || b || '-' || c"
_VOTE_SQL = f"WITH t AS (SELECT DISTINCT {_ID_SQL} AS id, a, b, c FROM ({VOTES.sql}))"


@query("vote_soft", f"""WITH t AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, a, b, c FROM ({VOTES.sql})),
p AS (SELECT (a + b + c) / 3 AS s FROM t)
SELECT CASE WHEN round(1 - s, 9) >= round(s * 0.5, 9) THEN 0 ELSE 1 END AS prediction, count(*) AS n, round(avg(greatest(1 - s, s * 0.5)), 6) AS confidence
FROM p GROUP BY 1""")
def soft_votes(spark, d):
    out = automl.vote_soft(vote_rows(spark, d))
    return out.groupBy("prediction").agg(F.count("*").alias("n"), tidy(F.avg("confidence")).alias("confidence"))


_HARD_SQL = f"""WITH t AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem),
v AS (SELECT l_orderkey AS id, ascii(l_returnflag) AS prediction FROM t UNION ALL SELECT l_orderkey, ascii(l_linestatus) FROM t)"""


def flag_votes(spark, d):
    t = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    t = automl.dealt(t, "l_orderkey", t.count()).distinct()
    both = F.explode(F.array(F.ascii("l_returnflag"), F.ascii("l_linestatus")))
    return t.select(F.col("l_orderkey").alias("id"), both.alias("prediction"))


@query("vote_hard", _HARD_SQL + """, c AS (SELECT id, prediction, count(*) AS n FROM v GROUP BY 1, 2)
SELECT id, arg_max(prediction, (n, -prediction)) AS prediction FROM c GROUP BY 1""")
def hard_votes(spark, d):
    return automl.vote_hard(flag_votes(spark, d))


@query("vote_mean", _HARD_SQL + " SELECT id, round(avg(prediction), 6) AS prediction FROM v GROUP BY 1")
def mean_votes(spark, d):
    return automl.vote_mean(flag_votes(spark, d)).withColumn("prediction", tidy(F.col("prediction")))


# ---- clustering of customers by balance and order total ----

def customer_points(spark, d):
    return cluster.scaled_vectors(value_columns(spark, d), "id", ["balance", "label"])


# a labeling both engines can compute: quartile of the scaled balance
POINT_SQL = """r AS (SELECT o_custkey AS id, c_acctbal AS x, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM r),
p AS (SELECT id, (x - mx) / sx AS x, (y - my) / sy AS y, CASE WHEN x < 2000 THEN -1 WHEN x < 5000 THEN 0 WHEN y < 2000000 THEN 1 ELSE 2 END AS label FROM r, s)"""


def labelled_points(spark, d):
    t = value_columns(spark, d)
    label = F.when(F.col("balance") < 2000, -1).when(F.col("balance") < 5000, 0).when(F.col("label") < 2000000, 1).otherwise(2)
    marks = t.select("id", F.array(label).alias("labels"))
    return customer_points(spark, d).join(marks, "id")


@query("silhouette", f"""WITH {POINT_SQL}, k AS (SELECT * FROM p WHERE label >= 0), z AS (SELECT label, count(*) AS n FROM k GROUP BY 1),
d AS (SELECT a.id, a.label AS own, b.label, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS t FROM k a, k b GROUP BY 1, 2, 3),
m AS (SELECT id, max(CASE WHEN own = d.label THEN t / (n - 1) END) AS a, min(CASE WHEN own <> d.label THEN t / n END) AS b FROM d JOIN z ON d.label = z.label GROUP BY 1)
SELECT 0 AS labeling, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m""")
def customer_silhouette(spark, d):
    return cluster.silhouette(labelled_points(spark, d).persist()).withColumn("silhouette", tidy(F.col("silhouette")))


_CENTER_SQL = f"""WITH {POINT_SQL}, k AS (SELECT * FROM p WHERE label >= 0), c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM k GROUP BY 1),
w AS (SELECT k.label, sum((x - cx) ** 2 + (y - cy) ** 2) AS within, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS spread FROM k JOIN c ON k.label = c.label GROUP BY 1),
g AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM k)"""


@query("calinski_harabasz", _CENTER_SQL + """ SELECT count(*) AS n_clusters,
 round(sum(c.n * ((cx - gx) ** 2 + (cy - gy) ** 2)) * (max(g.n) - count(*)) / (sum(within) * (count(*) - 1)), 4) AS calinski_harabasz FROM c JOIN w ON c.label = w.label, g""")
def customer_ch(spark, d):
    return cluster.cluster_shape(labelled_points(spark, d)).select("n_clusters", tidy(F.col("calinski_harabasz"), 4).alias("calinski_harabasz"))


@query("davies_bouldin", _CENTER_SQL + """, worst AS (SELECT a.label, max((wa.spread + wb.spread) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS r
 FROM c a JOIN c b ON a.label <> b.label JOIN w wa ON wa.label = a.label JOIN w wb ON wb.label = b.label GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin FROM worst""")
def customer_db(spark, d):
    return cluster.cluster_shape(labelled_points(spark, d)).select(tidy(F.col("davies_bouldin")).alias("davies_bouldin"))


@query("kmeans_sweep")
def customer_sweep(spark, d):
    return cluster.kmeans_sweep(customer_points(spark, d))[0]


@query("cluster_assign")
def customer_clusters(spark, d):
    points = customer_points(spark, d).persist()
    centers = cluster.kmeans_runs(points, [4])[4][1]
    return cluster.cluster_assign(points, centers).select("id", "label")


@query("dbscan")
def customer_dbscan(spark, d):
    t = customer_points(spark, d).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return cluster.dbscan(t, "id", ["x", "y"], 0.1, 5)
