"""Source, sink, image and stream queries. Files are first written by Spark from the given tables."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.cells import tidy
from tabloom.operators import headers, images, models, prep
from tabloom.plans.model_plans import VALUE_FEATURES, value_columns
from tabloom.plans.registry import Frame, query
from tabloom.session import load, scratch
from tabloom.sources import artifacts, delimited, files
from tabloom.streaming import events


@query("scan_csv", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def read_csv(spark, d):
    path = scratch(spark, "semicolon")
    load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).option("sep", ";").csv(path)
    return delimited.scan_csv(spark, path)


@query("scan_whitespace_table", "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_brand, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def read_whitespace(spark, d):
    path = scratch(spark, "blanks")
    t = load(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    t.write.option("header", True).option("sep", "   ").csv(path)
    return delimited.scan_whitespace_table(spark, path)


@query("scan_limit")
def first_rows(spark, d):
    return delimited.scan_limit(load(spark, d, "orders"), 5)


@query("sink_csv", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def write_csv(spark, d):
    path = scratch(spark, "orders-csv")
    delimited.sink_csv(load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    return spark.read.option("header", True).schema("o_orderkey bigint, o_orderpriority string, o_totalprice double").csv(path)


# box labels: one text line per line item, some malformed
BOXES = Frame("lineitem", "l_linestatus", "l_returnflag", """CASE WHEN l_linenumber = 7 THEN 'x 0.5 0.5 0.1 0.1' WHEN l_linenumber = 6 THEN '3 0.5 0.5'
 ELSE concat(CAST(l_linenumber AS VARCHAR(3)), ' ', CAST(l_discount AS VARCHAR(8)), ' ', CAST(l_tax AS VARCHAR(8)), '  0.25 0.5') END AS value""")


def label_files(spark, d) -> str:
    path = scratch(spark, "labels")
    BOXES(spark, d).write.partitionBy("l_linestatus", "l_returnflag").text(path)
    return path


@query("scan_detection_labels", f"""SELECT CAST(string_split(value, ' ')[1] AS INTEGER) AS class_id, CAST(string_split(value, ' ')[2] AS DOUBLE) AS cx,
 CAST(string_split(value, ' ')[3] AS DOUBLE) AS cy, 0.25::DOUBLE AS w, 0.5::DOUBLE AS h FROM ({BOXES.sql}) WHERE value NOT LIKE 'x%' AND value <> '3 0.5 0.5'""")
def box_labels(spark, d):
    return files.scan_detection_labels(spark, label_files(spark, d)).drop("file", "l_linestatus", "l_returnflag")


@query("detection_classes", """WITH m AS (SELECT max(l_linenumber) AS top FROM lineitem WHERE l_linenumber < 6)
SELECT CAST(i AS INTEGER) AS class_id, 'Class_' || i AS name FROM (SELECT unnest(generate_series(0, top)) AS i FROM m)""")
def box_classes(spark, d):
    return files.detection_classes(BOXES(spark, d).withColumns(files.parse_box_line()))


# ---- images: the 64 numbers of an embedding as an 8 x 8 grey picture ----

def pictures(spark, d) -> DataFrame:
    t = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    byte = F.transform("embedding", lambda x: F.lpad(F.hex((F.floor(F.least(F.greatest(x, F.lit(-1.0)), F.lit(0.99)) * 128 + 128)).cast("bigint")), 2, "0"))
    return t.select("id", "label", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"),
                    F.unhex(F.array_join(byte, "")).alias("data"))


def _bitmap(data: bytes, h: int, w: int) -> bytes:
    """24-bit bitmap file of a grey picture."""
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(bytes(v for x in data[r * w:(r + 1) * w] for v in (x, x, x)) + pad for r in reversed(range(h)))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


@query("scan_image_folder", "SELECT CAST(label AS VARCHAR) AS class, 8 AS height, 8 AS width, 3 AS channels, count(*) AS n FROM embeddings GROUP BY ALL")
def class_folders(spark, d):
    path = scratch(spark, "images")  # the shared folder, seen as a path by every executor

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                folder = f"{path.removeprefix('file:')}/all/{r.label}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{r.id}.bmp", "wb") as f:
                    f.write(_bitmap(r.data, r.height, r.width))
            yield b[["id"]]

    pictures(spark, d).mapInPandas(write, "id bigint").count()
    return files.scan_image_folder(spark, path).groupBy("class", "height", "width", "channels").agg(F.count("*").alias("n"))


_PIX = "SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(least(greatest(x, -1.0), 0.99) * 128 + 128)) AS p FROM embeddings"
_NORM = """list_transform(p, lambda x, i: round((x / 255.0 - CASE (i - 1) % 3 WHEN 0 THEN 0.406 WHEN 1 THEN 0.456 ELSE 0.485 END) /
 CASE (i - 1) % 3 WHEN 0 THEN 0.225 WHEN 1 THEN 0.224 ELSE 0.229 END, 6) + 0.0)"""


@query("image_normalize", f"""WITH t AS ({_PIX}), n AS (SELECT id, {_NORM} AS a, list_transform(p, lambda x: round(x / 127.5 - 1.0, 6) + 0.0) AS b, p FROM t)
SELECT id, unnest(range(64)) AS i, unnest(a) AS imagenet, unnest(b) AS centred, CAST(unnest(p) AS INTEGER) AS back FROM n""")
def normalized(spark, d):
    p = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(0.99)) * 128 + 128).cast("double"))
    t = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), p.alias("p"))
    t = t.withColumns({"a": images.normalize(F.col("p"), "imagenet"), "b": images.normalize(F.col("p"), "-1-1")})
    # nudged by less than one step, so that cutting off restores the byte
    t = t.withColumn("back", images.inverse_normalize(F.transform("b", lambda x: x + 1e-9), "-1-1"))
    rows = t.select("id", F.posexplode(F.arrays_zip("a", "b", "back")).alias("i", "s"))
    return rows.select("id", F.col("i").cast("bigint").alias("i"), tidy(F.col("s.a")).alias("imagenet"), tidy(F.col("s.b")).alias("centred"), F.col("s.back").alias("back"))


@query("image_resize")
def resized(spark, d):
    return images.image_resize(pictures(spark, d), 16, 12)


@query("image_augment")
def augmented(spark, d):
    return images.image_augment(pictures(spark, d), 2)


# ---- models on disk ----

def _saved(spark, d) -> tuple[str, DataFrame]:
    # a few numbers per customer; fitting and the schema pass over them a dozen times, and each pass would broadcast the customers
    t = value_columns(spark, d).persist()
    pre = prep.TabularPreprocessor(inputCols=VALUE_FEATURES)
    from pyspark.ml.regression import LinearRegression

    model = Pipeline(stages=[pre, LinearRegression(featuresCol="features", labelCol="label")]).fit(t)
    path = scratch(spark, "model")
    artifacts.save_model(model, path, headers.feature_schema(t, "label"), {"target": "label", "kind": "regression"})
    return path, t


@query("save_model")
def saved_schema(spark, d):
    path, _ = _saved(spark, d)
    return artifacts.load_model(spark, path)[2]


@query("load_model")
def loaded_predictions(spark, d):
    path, t = _saved(spark, d)
    model, meta, _ = artifacts.load_model(spark, path)
    return model.transform(t).select("id", "prediction", F.lit(meta["kind"]).alias("kind"))


# ---- streams over the event table ----

@query("stream_rate_alerts", """WITH e AS (SELECT event_type AS key, epoch_us(ts) AS us FROM events), m AS (SELECT max(us) // 1000 * 1000 - 600000000 AS closed FROM e),
w AS (SELECT key, (us // 10000000 - i) * 10000000 AS a FROM (SELECT key, us, unnest(range(6)) AS i FROM e)),
c AS (SELECT key, a, count(*) AS hits FROM w GROUP BY 1, 2)
SELECT key, make_timestamp(a) AS start, make_timestamp(a + 60000000) AS "end", hits FROM c, m WHERE hits > 1 AND a + 60000000 <= closed""")
def rate_alerts(spark, d):
    s = events.read_stream(spark, d, "events").withColumn("key", F.col("event_type"))
    return events.run_available(events.stream_rate_alerts(s, "key", limit=1), scratch(spark, "alerts"))


@query("stream_payment_dedup", "SELECT event_id AS payment_id, user_id, ts FROM events WHERE event_type = 'purchase'")
def deduped_payments(spark, d):
    s = events.read_stream(spark, d, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("payment_id"), "user_id", "ts")
    again = events.read_stream(spark, d, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("payment_id"), "user_id", "ts")
    out = events.stream_payment_dedup(s.union(again), ["payment_id"])
    return events.run_available(out, scratch(spark, "payments"))


@query("stream_plan_state", """WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
 CASE WHEN value > 40 THEN 365 ELSE 30 END AS days FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, k, ts + to_days(days) AS e FROM p WHERE k = 1
 UNION ALL SELECT p.user_id, p.k, greatest(p.ts, f.e) + to_days(p.days) FROM f JOIN p ON p.user_id = f.user_id AND p.k = f.k + 1)
SELECT user_id, epoch_us(max(e)) AS plan_end_micros, max(k) AS payments FROM f GROUP BY 1""")
def plan_state(spark, d):
    s = events.read_stream(spark, d, "events").where("event_type = 'purchase'").withColumn(
        "plan", F.when(F.col("value") > 40, "advance").otherwise("pro"))
    return events.run_available(events.stream_plan_state(s), scratch(spark, "plans"))


@query("stream_score", """WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b FROM orders)
SELECT o_orderkey AS id, round(a * o_custkey + b, 2) AS prediction FROM orders, m""")
def streamed_scores(spark, d):
    t = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("label"), array_to_vector(F.array(F.col("o_custkey").cast("double"))).alias("features"))
    trained = models.fit_linear(t, {})
    s = events.read_stream(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), array_to_vector(F.array(F.col("o_custkey").cast("double"))).alias("features"))
    out = events.run_available(events.stream_score(s, trained), scratch(spark, "scores"))
    return out.withColumn("prediction", tidy(F.col("prediction"), 2))

