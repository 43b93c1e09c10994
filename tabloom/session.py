"""Session helpers: table loading, reliable checkpoints and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; zone-less timestamps become zoned once, here."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    casts = {
        f.name: F.col(f.name).cast("timestamp")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def _shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach; a local folder only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tabloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage and cut its lineage there."""
    spark = df.sparkSession
    root = _shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table a query writes and reads back."""
    root = _shared_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back, for tables that loops rewrite.

    A checkpoint hands what the optimizer has inferred of its columns on to the next one; in a loop that doubles with every round.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `rows` rows; stops reading soon after the limit."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side whose size was checked; otherwise a shuffle join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def training_tasks(spark: SparkSession, rows: int, least: int, most: int) -> int:
    """Tasks for passes over `rows` small rows: one per `least` rows until every core has a few, then one per `most`."""
    return max(1, min(rows // least, max(3 * spark.sparkContext.defaultParallelism, -(-rows // most))))


def values_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed lookup table; one partition, so joining it costs one task."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which is one row by construction, to every row."""
    return df.join(F.broadcast(totals))
