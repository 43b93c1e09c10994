"""The same bookkeeping and scoring on streams.

Each function takes a streaming DataFrame with a zoned event time and returns one;
`run_available` drains what is there into a table, with its progress kept beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabloom.operators.models import Trained
from tabloom.operators.records import DAY_MICROS, FREE_RATE, PLAN_DAYS

LATENESS = "10 minutes"


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table's file as a file stream; new files of that name are picked up as they land."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return raw.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available, then read the result table."""
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress")
             .trigger(availableNow=True).start(f"{path}/rows"))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_rate_alerts(stream: DataFrame, key: str, time: str = "ts", limit: int = FREE_RATE) -> DataFrame:
    """Sliding one-minute windows in which a key made more than `limit` requests."""
    counts = stream.withWatermark(time, LATENESS).groupBy(F.window(time, "1 minute", "10 seconds"), key).agg(F.count("*").alias("hits"))
    return counts.where(F.col("hits") > limit).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "hits")


def stream_payment_dedup(stream: DataFrame, ids: list[str], time: str = "ts") -> DataFrame:
    """Each payment once, with state kept only for the lateness span."""
    return stream.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(ids)


def stream_plan_state(stream: DataFrame, time: str = "ts") -> DataFrame:
    """Plan end per user after each batch of payments (user_id, plan, time).

    The state of a user is two numbers. Within a batch a user's payments are two number
    arrays; the reader's maxFilesPerTrigger or maxBytesPerTrigger bounds their length.
    """
    days = F.when(F.col("plan") == "advance", PLAN_DAYS["advance"]).otherwise(PLAN_DAYS["pro"])
    fed = stream.select("user_id", F.unix_micros(time).alias("micros"), (days * F.lit(DAY_MICROS)).alias("bought"))
    schema = "user_id bigint, plan_end_micros bigint, payments bigint"

    def fold(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, seen = state.get if state.exists else (0, 0)
        parts = [p[["micros", "bought"]].to_numpy() for p in pieces]
        rows = np.concatenate(parts)
        rows = rows[rows[:, 0].argsort(kind="stable")]
        # closed form of end = max(t, end) + d, as in plan_expiry_fold
        upto = rows[:, 1].cumsum()
        start = max(int((rows[:, 0] - (upto - rows[:, 1])).max()), end)
        end, seen = start + int(upto[-1]), seen + len(rows)
        state.update((end, seen))
        yield pd.DataFrame({"user_id": [key[0]], "plan_end_micros": [end], "payments": [seen]})

    return fed.groupBy("user_id").applyInPandasWithState(
        fold, schema, "plan_end bigint, payments bigint", "append", GroupStateTimeout.NoTimeout)


def stream_score(stream: DataFrame, trained: Trained) -> DataFrame:
    """Predictions for rows as they arrive."""
    return trained.score(stream).select("id", "prediction")
