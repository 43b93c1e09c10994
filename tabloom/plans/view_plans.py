"""Header repair and table viewing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.cells import is_numeric_like, nan_to_null
from tabloom.operators import headers, view
from tabloom.plans.frames import EXPERIMENTS, JOBS, LINES, PEOPLE
from tabloom.plans.profile_plans import PEOPLE_TYPES
from tabloom.plans.registry import Frame, query
from tabloom.session import load

# column names of many tables: every order is a table, every line one of its columns
HEADERS = Frame(
    "lineitem", "l_orderkey AS table_id", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
    """CASE WHEN l_linenumber = 1 THEN concat('  Ship Mode (', l_returnflag, ') ')
 WHEN l_linenumber = 2 THEN concat(CAST(l_linenumber AS VARCHAR(5)), '.5 7e3 ', l_linestatus)
 WHEN l_linenumber = 3 THEN concat('Unnamed: ', CAST(l_suppkey AS VARCHAR(9)))
 WHEN l_linenumber = 4 THEN concat('col_', CAST(l_suppkey AS VARCHAR(9)))
 WHEN l_linenumber = 5 THEN concat('-', CAST(l_suppkey AS VARCHAR(9)), '.25')
 WHEN l_linenumber = 6 THEN CASE WHEN l_linestatus = 'F' THEN '' ELSE '1st' END
 ELSE concat(l_returnflag, '  ', l_linestatus, '--', 'a rather long column name that somebody wrote into a spreadsheet header cell')
 END AS name""")

NUM = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"
LIKE_SQL = f"""(trim(name) <> '' AND (regexp_matches(trim(name), '{NUM}') OR (len(regexp_split_to_array(trim(name), '\\s+')) > 1
 AND len(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda p: regexp_matches(p, '{NUM}'))) /
 len(regexp_split_to_array(trim(name), '\\s+')) >= 0.8)))"""
CLEAN_SQL = """substr(CASE WHEN regexp_matches(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^[a-z]')
 THEN regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') ELSE 'col_' || pos END, 1, 64)"""
# positions inside a table, from the line's own values
POS = "row_number() OVER (PARTITION BY table_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"
POS_SQL = f"SELECT *, {POS} AS pos FROM ({HEADERS.sql})"


def header_cells(spark, d):
    return HEADERS(spark, d).selectExpr("*", f"CAST({POS} AS BIGINT) AS pos")


@query("is_numeric_like", f"SELECT name, {LIKE_SQL} AS numeric_like, count(*) AS n FROM ({HEADERS.sql}) GROUP BY ALL")
def numeric_like_names(spark, d):
    return HEADERS(spark, d).select("name", is_numeric_like(F.col("name")).alias("numeric_like")).groupBy(
        "name", "numeric_like").agg(F.count("*").alias("n"))


@query("detect_headers", f"""WITH h AS (SELECT table_id, avg(CASE WHEN {LIKE_SQL} OR ltrim(name) LIKE 'Unnamed:%' THEN 1 ELSE 0 END) AS s
 FROM ({HEADERS.sql}) GROUP BY 1) SELECT table_id, round(s, 6) AS data_like, s >= 0.8 AS headers_missing FROM h""")
def missing_headers(spark, d):
    return headers.detect_headers(HEADERS(spark, d), ["table_id"]).withColumn("data_like", F.round("data_like", 6))


@query("snake_case_headers", f"SELECT table_id, pos, {CLEAN_SQL} AS clean FROM ({POS_SQL})")
def snake_headers(spark, d):
    return headers.snake_case_headers(header_cells(spark, d)).select("table_id", "pos", "clean")


@query("dedupe_headers", f"""WITH c AS (SELECT table_id, pos, {CLEAN_SQL} AS clean FROM ({POS_SQL})),
s AS (SELECT *, row_number() OVER (PARTITION BY table_id, clean ORDER BY pos) - 1 AS seen FROM c)
SELECT table_id, pos, CASE WHEN seen = 0 THEN clean ELSE clean || '_' || seen END AS header FROM s""")
def unique_headers(spark, d):
    return headers.dedupe_headers(header_cells(spark, d), ["table_id"]).select("table_id", "pos", "header")


@query("generic_header_ratio", f"""WITH h AS (SELECT table_id, avg(CASE WHEN regexp_matches(lower(trim(name)),
 '^(col|column|field|feature|value)_?[0-9]+$') THEN 1 ELSE 0 END) AS s FROM ({HEADERS.sql}) GROUP BY 1)
SELECT table_id, round(s, 6) AS generic, s > 0.5 AS too_generic FROM h""")
def generic_headers(spark, d):
    return headers.generic_header_ratio(HEADERS(spark, d), ["table_id"]).withColumn("generic", F.round("generic", 6))


CONTEXTS = Frame("documents", "doc_id", "concat('Housing ', source) AS context", "n_chars % 20 AS n_columns")


@query("canonical_headers", f"""SELECT doc_id, context, n_columns, CASE WHEN n_columns = 14 AND contains(lower(context), 'housing')
 THEN '{",".join(headers.HOUSING_COLUMNS)}' END AS headers FROM ({CONTEXTS.sql})""")
def housing_headers(spark, d):
    return headers.canonical_headers(CONTEXTS(spark, d)).withColumn("headers", F.array_join("headers", ","))


@query("set_headers", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey AS region_id FROM nation")
def renamed_nation(spark, d):
    return headers.set_headers(load(spark, d, "nation"), ["nation_id", "nation", "region_id"])


def _info_sql(frame, types):
    return f"WITH t AS ({frame.sql}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS null_count FROM t""" for c, t in types.items())


@query("column_info", _info_sql(PEOPLE, PEOPLE_TYPES))
def people_info(spark, d):
    return headers.column_info(PEOPLE(spark, d))


def _schema_sql() -> str:
    kinds = {"int64": "numeric", "int32": "numeric", "float64": "numeric", "object": "categorical", "bool": "boolean"}
    parts = []
    for c, t in PEOPLE_TYPES.items():
        if c == "active":
            continue
        num = kinds[t] == "numeric"
        stat = (f"""CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", round(avg({c}), 6) AS mean,
 round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median""" if num else
                """CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max", CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median""")
        cats = (f"""(SELECT string_agg(v, ';' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM t WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 50))"""
                if not num else "CAST(NULL AS VARCHAR)")
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing_count,
 '{kinds[t]}' AS semantic_type, {stat}, {cats} AS categories FROM t""")
    return f"WITH t AS ({PEOPLE.sql}) " + " UNION ALL ".join(parts)


def people_schema(spark, d):
    return headers.feature_schema(PEOPLE(spark, d), "active").withColumns(
        {"mean": F.round("mean", 6), "median": F.round("median", 6)})


query("feature_schema", _schema_sql())(people_schema)


@query("ui_schema", f"""WITH s AS ({_schema_sql()})
SELECT "column" AS name, CASE "column" WHEN 'customer_id' THEN 'Customer Id' ELSE upper("column"[1]) || "column"[2:] END AS label,
 true AS required, CASE semantic_type WHEN 'categorical' THEN 'categorical' ELSE 'number' END AS type,
 CASE semantic_type WHEN 'categorical' THEN 'dropdown' ELSE 'number' END AS input_type,
 CASE semantic_type WHEN 'categorical' THEN categories END AS options, "min", "max",
 CASE WHEN semantic_type = 'numeric' THEN coalesce(nullif(mean, 0), median) END AS "default" FROM s""")
def people_form(spark, d):
    return headers.ui_schema(people_schema(spark, d))


# the wanted target of a table is one of its names, a data row, or a name it does not have
TARGETS = Frame("orders", "o_orderkey AS table_id", """CASE o_orderstatus WHEN 'F' THEN concat('  Ship Mode (', 'R', ') ')
 WHEN 'O' THEN concat(CAST(o_custkey AS VARCHAR(9)), '.5 7.25') ELSE 'price' END AS target""")


@query("target_preflight", f"""WITH c AS ({HEADERS.sql}), t AS ({TARGETS.sql})
SELECT c.table_id, target, bool_or(name = target) AS "exists", count(*) FILTER (WHERE name <> target) >= 1 AS has_features,
 regexp_matches(target, '\\d+\\.\\d+.*\\d+\\.\\d+') AS name_is_data,
 bool_or(name = target) AND count(*) FILTER (WHERE name <> target) >= 1
 AND NOT regexp_matches(target, '\\d+\\.\\d+.*\\d+\\.\\d+') AS ok
FROM c JOIN t ON c.table_id = t.table_id GROUP BY c.table_id, target""")
def preflight(spark, d):
    return headers.target_preflight(HEADERS(spark, d).select("table_id", "name"), TARGETS(spark, d), "table_id")


@query("close_column_match", """WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS "column" FROM nation),
s AS (SELECT DISTINCT 'Nation_' || s_nationkey AS suggested FROM supplier)
SELECT suggested, arg_min("column", pos) AS "column" FROM s JOIN c ON contains(lower("column"), lower(suggested)) GROUP BY 1""")
def match_names(spark, d):
    cols = load(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("column"))
    wanted = load(spark, d, "supplier").select(F.concat(F.lit("Nation_"), F.col("s_nationkey")).alias("suggested"))
    return headers.close_column_match(cols, wanted.distinct())


# ---- view ----

RATIOS = Frame("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
               "CASE WHEN l_discount = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_tax = 0 THEN CAST('Infinity' AS DOUBLE)"
               " WHEN l_tax = 0.08 THEN CAST('-Infinity' AS DOUBLE) ELSE l_quantity END AS ratio")


@query("nan_to_null", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
 CASE WHEN isfinite(ratio) THEN ratio END AS ratio FROM ({RATIOS.sql})""")
def finite_ratios(spark, d):
    return nan_to_null(RATIOS(spark, d))


@query("preview", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
 (SELECT count(*) FROM orders) AS total_rows, 6 AS total_columns, (SELECT count(*) FROM orders) > 500 AS truncated
 FROM orders ORDER BY o_orderkey LIMIT 500""")
def orders_preview(spark, d):
    return view.preview(load(spark, d, "orders"), ["o_orderkey"])


def _preview_stats_sql() -> str:
    parts = []
    for c, t in PEOPLE_TYPES.items():
        num = t.startswith(("int", "float"))
        kind = "numeric" if num else "categorical" if t == "object" else "other"
        stat = (f'CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", round(avg({c}), 4) AS mean' if num else
                'CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max", CAST(NULL AS DOUBLE) AS mean')
        top = (f"""(SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM t
 WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))""" if kind == "categorical" else "CAST(NULL AS VARCHAR)")
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS null_count,
 count(DISTINCT {c}) AS unique_count, {stat}, '{kind}' AS kind, {top} AS top_values FROM t""")
    return f"WITH t AS ({PEOPLE.sql}) " + " UNION ALL ".join(parts)


@query("preview_column_stats", _preview_stats_sql())
def people_preview_stats(spark, d):
    return view.preview_column_stats(PEOPLE(spark, d))


@query("search_any_column", """SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
 WHERE contains(lower(p_name), 'ing') OR contains(lower(p_brand), 'ing') OR contains(lower(p_type), 'ing')
 OR contains(CAST(p_partkey AS VARCHAR), 'ing') OR contains(CAST(p_size AS VARCHAR), 'ing')""")
def search_parts(spark, d):
    return view.search_any_column(load(spark, d, "part"), "ING")


@query("sort_nulls_last", f"""SELECT customer_id, balance, row_number() OVER (ORDER BY balance DESC NULLS LAST, customer_id) AS place
 FROM ({PEOPLE.sql})""")
def sorted_people(spark, d):
    from tabloom.functions.ordering import row_positions

    # the order itself is the result, so each row carries its place
    keyed = PEOPLE(spark, d).select("customer_id", "balance").withColumns({
        "__null": F.col("balance").isNull(), "__key": -F.col("balance")})
    ranked = row_positions(keyed, [], ["__null", "__key", "customer_id"], "place")
    return view.sort_nulls_last(
        ranked.select("customer_id", "balance", (F.col("place") + 1).alias("place")), "balance", True, "customer_id")


@query("paginate", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, 3 AS page,
 CAST(greatest(ceil((SELECT count(*) FROM orders) / 50.0), 1) AS BIGINT) AS pages
 FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100""")
def orders_page(spark, d):
    return view.paginate(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 3)


@query("drop_null_target", f"SELECT customer_id, balance FROM ({PEOPLE.sql}) WHERE balance IS NOT NULL")
def people_with_target(spark, d):
    return view.drop_null_target(PEOPLE(spark, d).select("customer_id", "balance"), "balance")


@query("split_features_target", "SELECT l_quantity, l_discount, l_tax FROM lineitem")
def line_features(spark, d):
    t = load(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return view.split_features_target(t, "l_extendedprice")[0]


@query("leaderboard", f"""WITH j AS ({JOBS.sql}), r AS (SELECT experiment_id, model, score,
 row_number() OVER (PARTITION BY experiment_id ORDER BY score DESC NULLS LAST, position, run_key, feature_key) AS rank FROM j)
SELECT experiment_id, model, score, rank, rank = 1 AS best, rank <= 3 AS in_top FROM r""")
def job_leaderboard(spark, d):
    j = JOBS(spark, d).withColumn("position", F.struct("position", "run_key", "feature_key"))
    return view.leaderboard(j, ["experiment_id"]).select(
        "experiment_id", "model", "score", F.col("rank").cast("bigint").alias("rank"), "best", "in_top")


@query("search_models", f"""SELECT id, name, created_at, package_path FROM ({EXPERIMENTS.sql})
 WHERE contains(lower(name), 'urgent') AND package_path IS NOT NULL""")
def urgent_models(spark, d):
    m = EXPERIMENTS(spark, d)
    return view.search_models(m, "URGENT", packaged=True).select("id", "name", "created_at", "package_path")


@query("dashboard_summary", f"""WITH e AS ({EXPERIMENTS.sql} WHERE o_orderstatus = 'F')
SELECT (SELECT count(*) FROM documents) AS total_datasets, (SELECT count(*) FROM e) AS trained_models,
 (SELECT max(coalesce(best_score, 0)) FROM e) AS best_score,
 (SELECT string_agg(DISTINCT problem_type, ', ' ORDER BY problem_type) FROM e) AS types""")
def dashboard(spark, d):
    models = EXPERIMENTS(spark, d).where("status = 'completed'")
    return view.dashboard_summary(load(spark, d, "documents").select("doc_id"), models)
