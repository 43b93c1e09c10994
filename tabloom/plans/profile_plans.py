"""Profiling, problem detection and insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.cells import tidy
from tabloom.operators import detect, insights, profile
from tabloom.plans.frames import EXPERIMENTS, JOBS, LINES, PEOPLE, VISITS
from tabloom.plans.registry import Frame, query
from tabloom.session import load

# pandas dtypes of the frames' columns, for the SQL side
PEOPLE_TYPES = {"customer_id": "int64", "nation": "int32", "segment": "object", "balance": "float64",
                "hobby": "object", "k": "float64", "active": "bool"}
LINE_TYPES = {"l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int32",
              "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64",
              "l_returnflag": "object", "l_linestatus": "object", "l_shipdate": "datetime64[ns]"}

SEMANTIC_SQL = """CASE
 WHEN regexp_matches(lower("column"), 'date|time|created|updated') THEN 'timestamp'
 WHEN contains(lower("column"), 'id') THEN 'identifier'
 WHEN dtype = 'object' AND unique_count / n < 0.05 THEN 'categorical'
 WHEN dtype = 'object' THEN 'text'
 WHEN (dtype LIKE 'int%' OR dtype LIKE 'float%') AND unique_count <= 10 THEN 'categorical'
 WHEN dtype LIKE 'int%' OR dtype LIKE 'float%' THEN 'numeric' ELSE 'unknown' END"""


def column_profile_sql(frame: Frame, types: dict[str, str]) -> str:
    parts = [f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS n, count(*) - count({c}) AS missing_count,
 count(DISTINCT {c}) AS unique_count FROM t""" for c, t in types.items()]
    return f"""WITH t AS ({frame.sql}), p AS ({' UNION ALL '.join(parts)})
SELECT "column", dtype, missing_count, round(missing_count * 100.0 / n, 6) AS missing_pct, unique_count,
 {SEMANTIC_SQL} AS semantic_type FROM p"""


def numeric_stats_sql(frame: Frame, columns: list[str]) -> str:
    parts = [f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
 round(avg({c}), 4) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
 round(stddev_samp({c}), 4) AS std,
 CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE round(skewness({c}), 6) + 0.0 END AS skewness,
 count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives FROM t""" for c in columns]
    return f"WITH t AS ({frame.sql}) {' UNION ALL '.join(parts)}"


def _tidy_stats(df):
    return df.withColumns({"mean": tidy(F.col("mean"), 4), "median": tidy(F.col("median")),
                           "std": tidy(F.col("std"), 4), "skewness": tidy(F.col("skewness"))})


def profile_sql(frame: Frame, types: dict[str, str]) -> str:
    numbers = [c for c, t in types.items() if t.startswith(("int", "float"))]
    dates = [c for c, t in types.items() if t.startswith("datetime")]
    spans = [f"""SELECT '{c}' AS "column", min({c}) AS min_date, max({c}) AS max_date,
 CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000) AS BIGINT) AS range_days FROM t""" for c in dates]
    spans.append('SELECT NULL AS "column", CAST(NULL AS TIMESTAMP) AS min_date, CAST(NULL AS TIMESTAMP) AS max_date,'
                 ' CAST(NULL AS BIGINT) AS range_days FROM t WHERE false')
    return f"""SELECT p.*, s."min", s."max", s.mean, s.median, s.std, s.skewness, s.zeros, s.negatives,
 d.min_date, d.max_date, d.range_days
FROM ({column_profile_sql(frame, types)}) p
LEFT JOIN ({numeric_stats_sql(frame, numbers)}) s ON p."column" = s."column"
LEFT JOIN (WITH t AS ({frame.sql}) {' UNION ALL '.join(spans)}) d ON p."column" = d."column" """


@query("profile_dataset", profile_sql(LINES, LINE_TYPES))
def profile_lines(spark, d):
    out = _tidy_stats(profile.profile_dataset(LINES(spark, d)))
    return out.withColumn("missing_pct", tidy(F.col("missing_pct")))


@query("column_profile", column_profile_sql(PEOPLE, PEOPLE_TYPES))
def people_columns(spark, d):
    return profile.column_profile(PEOPLE(spark, d)).withColumn("missing_pct", tidy(F.col("missing_pct")))


@query("numeric_stats", numeric_stats_sql(PEOPLE, ["customer_id", "nation", "balance", "k"]))
def people_numbers(spark, d):
    return _tidy_stats(profile.numeric_stats(PEOPLE(spark, d)))


@query("semantic_type", f"""SELECT "column", semantic_type FROM ({column_profile_sql(LINES, LINE_TYPES)})""")
def line_semantics(spark, d):
    return profile.column_profile(LINES(spark, d)).select("column", "semantic_type")


_GROUPS = """WITH g AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)"""


@query("basic_info", f"""{_GROUPS} SELECT CAST(sum(n) AS BIGINT) AS num_rows, 3 AS num_columns,
 CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""")
def visit_info(spark, d):
    return profile.basic_info(VISITS(spark, d))


@query("duplicate_rows", f"""{_GROUPS} SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
 round(sum(n - 1) * 100.0 / sum(n), 6) AS duplicate_pct FROM g""")
def visit_duplicates(spark, d):
    return profile.duplicate_rows(VISITS(spark, d)).withColumn("duplicate_pct", tidy(F.col("duplicate_pct")))


@query("estimated_bytes", """SELECT CAST(count(*) * 16 + sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source)) AS BIGINT)
 AS bytes, round((count(*) * 16 + sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source))) / 1048576.0, 6) AS mb
 FROM documents""")
def document_bytes(spark, d):
    return profile.estimated_bytes(load(spark, d, "documents")).withColumn("mb", tidy(F.col("mb")))


def _top_sql(frame: Frame, columns: list[str], k: int) -> str:
    parts = [f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
 CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM t WHERE {c} IS NOT NULL GROUP BY {c}"""
             for c in columns]
    return f"WITH t AS ({frame.sql}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rank <= {k}"


PARTS = Frame("part", "p_name", "p_brand", "p_type")


@query("top_values", _top_sql(PARTS, ["p_name", "p_brand", "p_type"], 10))
def part_top_values(spark, d):
    return profile.top_values(PARTS(spark, d))


ORDER_DATES = Frame("orders", "o_orderdate")


@query("datetime_stats", """SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date,
 CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) AS BIGINT) AS range_days FROM orders""")
def order_dates(spark, d):
    return profile.wide_stats(ORDER_DATES(spark, d)).select("min_date", "max_date", "range_days")


@query("missing_summary", f"""WITH p AS ({column_profile_sql(PEOPLE, PEOPLE_TYPES)})
SELECT "column", missing_count, missing_pct, CAST(sum(missing_count) OVER () AS BIGINT) AS total_missing,
 count(*) FILTER (WHERE missing_count > 0) OVER () AS columns_with_missing FROM p""")
def people_missing(spark, d):
    return profile.missing_summary(PEOPLE(spark, d)).withColumn("missing_pct", tidy(F.col("missing_pct")))


NUMBERS = Frame("lineitem", "l_quantity", "l_extendedprice", "l_discount",
                "CASE WHEN l_tax > 0 THEN l_tax END AS l_tax", "CAST(5 AS DOUBLE) AS k")


def _corr_sql(frame: Frame, columns: list[str], pairs: str = "all") -> str:
    parts = []
    for a in columns:
        for b in columns:
            parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) = 0
 OR stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL) = 0 THEN NULL ELSE round(corr({a}, {b}), 6) + 0.0 END AS corr FROM t""")
    return f"WITH t AS ({frame.sql}) {' UNION ALL '.join(parts)}"


_NUMBER_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "k"]


@query("correlation_matrix", _corr_sql(NUMBERS, _NUMBER_COLUMNS))
def line_correlations(spark, d):
    return profile.correlation_matrix(NUMBERS(spark, d)).withColumn("corr", tidy(F.col("corr")))


@query("target_correlations", f"""WITH c AS (SELECT a AS feature, abs(corr) AS abs_corr FROM ({_corr_sql(NUMBERS, _NUMBER_COLUMNS)})
 WHERE b = 'l_extendedprice' AND a <> b AND corr IS NOT NULL)
SELECT feature, abs_corr, CAST(row_number() OVER (ORDER BY abs_corr DESC, feature) AS INTEGER) AS rank,
 row_number() OVER (ORDER BY abs_corr DESC, feature) <= 5 AS top, abs_corr < 0.05 AS weak FROM c""")
def price_correlations(spark, d):
    return profile.target_correlations(NUMBERS(spark, d), "l_extendedprice").withColumn("abs_corr", tidy(F.col("abs_corr")))


GAPPY_VISITS = Frame("events", "user_id", "event_type", "CAST(ts AS DATE) AS day",
                     "CASE WHEN event_type <> 'error' THEN user_id END AS known_user")


@query("quality_score", """WITH g AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n,
 count(*) FILTER (WHERE event_type = 'error') AS m FROM events GROUP BY ALL),
s AS (SELECT sum(m) * 100.0 / (sum(n) * 4) AS missing_pct, sum(n - 1) * 100.0 / sum(n) AS duplicate_pct FROM g)
SELECT round(missing_pct, 6) AS missing_pct, round(duplicate_pct, 6) AS duplicate_pct,
 round(100.0 - least(missing_pct, 30.0) - least(duplicate_pct, 20.0), 2) AS quality_score FROM s""")
def visit_quality(spark, d):
    return profile.quality_score(GAPPY_VISITS(spark, d)).withColumns(
        {"missing_pct": tidy(F.col("missing_pct")), "duplicate_pct": tidy(F.col("duplicate_pct"))})


@query("target_analysis", """WITH t AS (SELECT l_quantity AS v FROM lineitem),
c AS (SELECT v, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY v),
r AS (SELECT CAST(v AS VARCHAR) AS value, n, CAST(row_number() OVER (ORDER BY n DESC, CAST(v AS VARCHAR)) AS INTEGER) AS rank FROM c),
s AS (SELECT count(*) - count(v) AS missing_count, min(v) AS "min", max(v) AS "max", round(avg(v), 6) AS mean,
 round(stddev_samp(v), 6) AS std, count(DISTINCT v) AS unique_count FROM t)
SELECT * FROM r CROSS JOIN s WHERE rank <= 10""")
def quantity_target(spark, d):
    out = profile.target_analysis(load(spark, d, "lineitem").select("l_quantity"), "l_quantity")
    return out.withColumns({"mean": tidy(F.col("mean")), "std": tidy(F.col("std"))})


PAGE_PATHS = Frame("pages", "page_id", "concat(replace(url, 'http://', ''), "
                   "CASE WHEN page_id % 3 = 0 THEN '.PNG' WHEN page_id % 3 = 1 THEN '.jpg' ELSE '' END) AS path")
CLASS_SQL = """WITH t AS (%s), p AS (SELECT page_id, path, string_split(path, '/') AS parts FROM t),
q AS (SELECT page_id, path, parts[-1] AS file, CASE WHEN len(parts) < 2 THEN NULL WHEN len(parts) = 2 THEN parts[1]
 WHEN len(parts) = 3 THEN parts[2] ELSE parts[-2] END AS folder FROM p),
c AS (SELECT page_id, path, file, CASE WHEN regexp_matches(file, '(?i)\\.(jpg|jpeg|png|bmp|gif|webp|tiff)$')
 AND file NOT LIKE '.%%' AND folder NOT LIKE '\\_\\_%%' ESCAPE '\\' AND folder NOT LIKE '.%%' THEN folder END AS class FROM q)
""" % PAGE_PATHS.sql


@query("class_from_path", CLASS_SQL + "SELECT page_id, path, class FROM c")
def page_classes(spark, d):
    return PAGE_PATHS(spark, d).withColumn("class", profile.class_from_path(F.col("path")))


@query("class_counts", CLASS_SQL + """, r AS (SELECT class, path, row_number() OVER (PARTITION BY class ORDER BY path, page_id) AS k
 FROM c WHERE class IS NOT NULL)
SELECT class, count(*) AS n, string_agg(path, ';' ORDER BY path) FILTER (WHERE k <= 3) AS samples FROM r
GROUP BY class""")
def page_class_counts(spark, d):
    pages = page_classes(spark, d).where(F.col("class").isNotNull())
    return profile.class_counts(pages, "class", "path")


@query("imbalance_flag", """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
SELECT min(n) AS smallest, max(n) AS largest, round(min(n) / max(n), 6) AS ratio, min(n) / max(n) <= 0.2 AS imbalanced FROM c""")
def toxic_imbalance(spark, d):
    return profile.imbalance_flag(load(spark, d, "labels"), "toxic").withColumn("ratio", tidy(F.col("ratio")))


@query("class_weights", """WITH c AS (SELECT l_linenumber * 2 AS class_id, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT max(class_id) AS hi, sum(n) AS total, count(*) AS k FROM c),
i AS (SELECT unnest(generate_series(0, hi)) AS class_id, total, k FROM s)
SELECT CAST(i.class_id AS BIGINT) AS class_id, coalesce(c.n, 0) AS n,
 coalesce(round(i.total / (i.k * c.n), 6), 1.0) AS weight FROM i LEFT JOIN c ON i.class_id = c.class_id""")
def line_class_weights(spark, d):
    # twice the line number, so that the odd class ids are empty
    labels = load(spark, d, "lineitem").select((F.col("l_linenumber") * 2).alias("y"))
    return profile.class_weights(labels, "y").withColumn("weight", tidy(F.col("weight")))


# ---- detection ----

@query("detect_data_type", "SELECT CASE WHEN count(*) > 0 THEN 'timeseries' ELSE 'tabular' END AS data_type FROM orders")
def orders_data_type(spark, d):
    return detect.detect_data_type(load(spark, d, "orders"), ["o_orderkey"])


@query("detect_datetime_column", "SELECT 'd' AS \"column\" FROM orders LIMIT 1")
def text_datetime_column(spark, d):
    texts = load(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("d"), "o_orderpriority")
    # numbers parse as dates too, so the key is left out
    return detect.detect_datetime_column(
        texts.select(F.col("o_orderpriority").alias("p"), "d", F.col("o_orderkey").cast("string").alias("k")),
        ["k"])


@query("select_by_type", """WITH c AS (SELECT * FROM (VALUES (0, 'customer_id', 'numeric'), (1, 'nation', 'numeric'),
 (2, 'segment', 'categorical'), (3, 'balance', 'numeric'), (4, 'hobby', 'categorical'), (5, 'k', 'numeric'),
 (6, 'active', 'categorical')) v(pos, "column", kind)), p AS (%s)
SELECT c.pos, c."column", c.kind, false AS datetime_like, p.unique_count FROM c JOIN p ON c."column" = p."column" """
       % column_profile_sql(PEOPLE, PEOPLE_TYPES))
def people_by_type(spark, d):
    return detect.select_by_type(PEOPLE(spark, d))


# (frame, target, goal) cases, decided by the rules from the tables' own values
CASES = [
    ("orders", "o_orderstatus", ""), ("orders", "o_totalprice", ""), ("orders", "o_orderdate", ""),
    ("orders", "o_orderpriority", ""), ("orders", "o_totalprice", "forecast next month demand"),
    ("lineitem", "l_linestatus", ""), ("lineitem", "l_linenumber", ""), ("lineitem", "l_quantity", ""),
    ("events", "event_id", ""), ("labels", "toxic", ""), ("part", "p_name", ""), ("part", "missing", ""),
    ("part", None, ""),
]
_KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey"], "events": ["event_id"],
         "labels": ["doc_id"], "part": ["p_partkey"]}


def _detect_sql() -> str:
    parts = []
    numeric = {"o_totalprice", "l_linenumber", "l_quantity", "event_id", "toxic"}
    for table, target, goal in CASES:
        if target is None or target == "missing":
            kind, conf = ("clustering", 0.8) if target is None else ("unknown", 0.0)
            name = "CAST(NULL AS VARCHAR)" if target is None else f"'{target}'"
            parts.append(f"SELECT '{table}' AS source, '{goal}' AS goal, {name} AS target, '{kind}' AS problem_type,"
                         f" CAST({conf} AS DOUBLE) AS confidence FROM (SELECT count(*) FROM {table})")
            continue
        num = "true" if target in numeric else "false"
        whole = f"bool_and(abs({target} - trunc({target})) <= 1e-8 + 1e-5 * abs({target}))" if target in numeric else "false"
        hint = any(p in target for p in detect.CLASS_NAME_PARTS)
        idlike = target.endswith("_id")
        dated = target == "o_orderdate"
        forecast = bool(goal) and table == "orders"
        parts.append(f"""SELECT '{table}' AS source, '{goal}' AS goal, '{target}' AS target, CASE
 WHEN {forecast} THEN 'timeseries' WHEN u / n > 0.9 AND {idlike} THEN 'classification' WHEN {dated} THEN 'timeseries'
 WHEN u = 2 THEN 'binary_classification' WHEN u <= 20 AND (u / n <= 0.2 OR {hint}) THEN 'multiclass_classification'
 WHEN NOT {num} AND u <= least(100, greatest(20, n * 0.5)) THEN 'multiclass_classification'
 WHEN {num} AND w AND u <= 50 AND u / n <= 0.1 THEN 'multiclass_classification'
 WHEN {num} THEN 'regression' WHEN u <= 50 THEN 'multiclass_classification' ELSE 'regression' END AS problem_type,
 CAST(CASE WHEN {forecast} THEN 0.9 WHEN u / n > 0.9 AND {idlike} THEN 0.45 WHEN {dated} THEN 0.75 WHEN u = 2 THEN 0.95
 WHEN u <= 20 AND (u / n <= 0.2 OR {hint}) THEN 0.9
 WHEN NOT {num} AND u <= least(100, greatest(20, n * 0.5)) THEN 0.75
 WHEN {num} AND w AND u <= 50 AND u / n <= 0.1 THEN 0.75
 WHEN {num} THEN 0.9 WHEN u <= 50 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence
 FROM (SELECT count({target}) AS n, count(DISTINCT {target}) AS u, {whole} AS w FROM {table})""")
    return " UNION ALL ".join(parts)


@query("detect_problem_type", _detect_sql())
def problem_types(spark, d):
    out = None
    for table, target, goal in CASES:
        one = detect.detect_problem_type(load(spark, d, table), target, _KEYS[table], goal).select(
            F.lit(table).alias("source"), F.lit(goal).alias("goal"), "target", "problem_type", "confidence")
        out = one if out is None else out.unionByName(one)
    return out


_TYPE_SQL = """WITH e AS (%s) SELECT id, CASE WHEN status = 'failed' THEN 'timeseries' WHEN problem_type = 'regression' THEN 'regression'
 WHEN problem_type IS NULL THEN 'ranking' ELSE 'binary_classification' END AS problem_type FROM e""" % EXPERIMENTS.sql


@query("recommended_algorithms", f"""SELECT id, problem_type, CASE problem_type
 WHEN 'binary_classification' THEN 'logistic_regression,random_forest,xgboost'
 WHEN 'regression' THEN 'linear_regression,random_forest,xgboost'
 WHEN 'timeseries' THEN 'arima,prophet,lstm' ELSE 'random_forest' END AS algorithms FROM ({_TYPE_SQL})""")
def experiment_algorithms(spark, d):
    e = EXPERIMENTS(spark, d).select(
        "id", F.expr("""CASE WHEN status = 'failed' THEN 'timeseries' WHEN problem_type = 'regression' THEN 'regression'
        WHEN problem_type IS NULL THEN 'ranking' ELSE 'binary_classification' END""").alias("problem_type"))
    return detect.recommended_algorithms(e)


@query("preprocessing_suggestions", f"""WITH t AS ({PEOPLE.sql})
SELECT 'handle_missing' AS step, CAST(2 * count(*) - count(balance) - count(hobby) AS VARCHAR) AS detail FROM t
 HAVING 2 * count(*) > count(balance) + count(hobby)
UNION ALL SELECT 'encode_categorical', 'segment,hobby' FROM (SELECT count(*) FROM t)
UNION ALL SELECT 'high_cardinality', c FROM (SELECT 'segment' AS c, count(DISTINCT segment) AS u FROM t
 UNION ALL SELECT 'hobby', count(DISTINCT hobby) FROM t) WHERE u > 50
UNION ALL SELECT 'scale_numeric', '' FROM t HAVING greatest(max(balance) - min(balance), max(customer_id) - min(customer_id)) > 1000""")
def people_suggestions(spark, d):
    return detect.preprocessing_suggestions(PEOPLE(spark, d))


DECISIONS = Frame(
    "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
    "CASE l_returnflag WHEN 'A' THEN 'regression' WHEN 'N' THEN 'multiclass_classification' ELSE 'timeseries' END AS rule_type",
    "0.5 + l_quantity / 100 AS rule_confidence",
    "CASE l_linestatus WHEN 'F' THEN 'binary_classification' ELSE 'unknown' END AS other_type",
    "0.8 + l_discount * 2 AS other_confidence", "l_linenumber * 5 AS target_uniques")


@query("arbitrate_problem_type", f"""WITH t AS ({DECISIONS.sql}), c AS (SELECT *, CASE WHEN other_type <> 'unknown' AND other_type <> rule_type
 AND other_confidence >= 0.85 AND other_confidence >= rule_confidence + 0.1 THEN other_type ELSE rule_type END AS problem_type FROM t)
SELECT problem_type, family, count(*) AS n FROM (SELECT problem_type, CASE WHEN contains(problem_type, 'classification') THEN 'classification'
 WHEN problem_type = 'regression' THEN 'regression' WHEN target_uniques <= 20 THEN 'classification' ELSE 'regression' END AS family FROM c)
 GROUP BY ALL""")
def arbitration(spark, d):
    t = DECISIONS(spark, d).withColumns({"rule_confidence": F.col("rule_confidence").cast("double"),
                                         "other_confidence": F.col("other_confidence").cast("double")})
    return detect.arbitrate_problem_type(t).groupBy("problem_type", "family").agg(F.count("*").alias("n"))


# ---- insights ----

@query("dataset_insights", """WITH t AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
s AS (SELECT count(*) AS n, count(DISTINCT l_extendedprice) AS u, abs(corr(l_extendedprice, l_quantity)) AS a,
 abs(corr(l_extendedprice, l_discount)) AS b, abs(corr(l_extendedprice, l_tax)) AS c FROM t),
k AS (SELECT string_agg(f, ', ' ORDER BY v DESC) AS names FROM (SELECT 'l_quantity' AS f, a AS v FROM s
 UNION ALL SELECT 'l_discount', b FROM s UNION ALL SELECT 'l_tax', c FROM s))
SELECT 0 AS line_no, 'Your data contains ' || format('{:,}', n) || ' examples to learn from.' AS line FROM s
UNION ALL SELECT 1, 'Found 3 different factors that might influence predictions.' FROM s
UNION ALL SELECT 2, CASE WHEN u < 20 THEN 'The model will learn to predict ' || u || ' different categories.'
 ELSE 'The model will learn to predict numeric values for l_extendedprice.' END FROM s
UNION ALL SELECT 3, 'Key factors that may influence predictions: ' || names FROM k""")
def price_insights(spark, d):
    t = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return insights.dataset_insights(t, "l_extendedprice")


@query("model_insights", f"""WITH j AS ({JOBS.sql}),
b AS (SELECT experiment_id AS experiment, arg_max(model, (score, model)) AS m, max(score) AS s FROM j GROUP BY 1),
f AS (SELECT experiment_id AS experiment, arg_max(feature_key, (importance, feature_key)) AS f, max(importance) AS i FROM j GROUP BY 1)
SELECT experiment, 'winner' AS kind, m || ' achieved highest accuracy at ' || format('{{:.1f}}', round(s * 100, 1)) || '%' AS line FROM b
UNION ALL SELECT experiment, 'top_feature', 'Model identified ' || f || ' as most important (importance: ' || format('{{:.2f}}', i) || ')' FROM f""")
def job_insights(spark, d):
    j = JOBS(spark, d)
    return insights.model_insights(
        j.select(F.col("experiment_id").alias("experiment"), "model", "score"),
        j.select(F.col("experiment_id").alias("experiment"), F.col("feature_key").alias("feature"), "importance"))
