"""Shared pieces of the training-data operators: words, scratch tables, row mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import scratch

#: The six ASCII space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Hand fewer rows at once to Python while a job runs, where workers already hold large tables."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove the shuffle files of a job when it ends, where jobs in a row each write their result as a table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    This cuts the lineage on storage that survives lost executors, and gives the optimizer the table's real size, so
    that it broadcasts a small table and shuffles a large one by itself.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def boxed(docs: DataFrame) -> DataFrame:
    """One struct column `row`: columns computed beside it cannot clash with those of the input."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unboxed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than the six ASCII spaces; empty for null and blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES_RE))


def map_batches(
    df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]], make: Callable[[], object] | None = None
) -> DataFrame:
    """Map columns to columns batch by batch with plain Python or numpy code inside the tasks.

    `fn` gets a dict of Python lists (one per input column) and returns one of equally named output columns. With `make`,
    `fn` gets its result as second argument; it is built once per task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make() if make else None
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(names)}
                out = fn(columns, state) if make else fn(columns)
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)
