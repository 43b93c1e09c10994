"""Delimited text: delimiter sniffing, white-space tables, CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES = 20
UNNAMED_SHARE = 0.25


def _head(spark: SparkSession, path: str, n: int = SNIFF_LINES) -> list[str]:
    """First lines of the first file by name."""
    files = sorted(spark.read.text(path).inputFiles())
    return [r["value"] for r in spark.read.text(files[0]).limit(n).collect()] if files else []


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """Lines of all files; with a header, without the first line of each file."""
    reader = spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("header", header)
    return reader.option("enforceSchema", True).csv(path)


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that cuts the first lines into the same number of fields, most fields first."""
    best, score = ",", (0, 0)
    for d in DELIMITERS:
        counts = [line.count(d) for line in lines if line.strip()]
        if not counts or counts[0] == 0:
            continue
        got = (sum(c == counts[0] for c in counts) / len(counts), counts[0])
        if got > score:
            best, score = d, got
    return best


def _unnamed(df: DataFrame) -> float:
    return sum(c.startswith(("_c", "Unnamed:")) for c in df.columns) / max(len(df.columns), 1)


def scan_csv(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | str | None = None, rows: int | None = None) -> DataFrame:
    """CSV with a sniffed delimiter; falls back to white space when that fits better.

    Only the first lines are looked at. Give a schema to spare the inference scan.
    """
    lines = _head(spark, path)
    reader = spark.read.option("header", header).option("sep", sniff_delimiter(lines))
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    first = lines[0].split() if lines else []
    if schema is None and len(first) > 1 and (len(df.columns) == 1 or (header and _unnamed(df) >= UNNAMED_SHARE)):
        wide = scan_whitespace_table(spark, path, header)
        if len(wide.columns) >= len(df.columns) or _unnamed(wide) < _unnamed(df):
            df = wide
    return df.limit(rows) if rows is not None else df


def scan_whitespace_table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Table whose fields are separated by runs of white space; numbers become doubles."""
    text = _lines(spark, path, header)
    lines = _head(spark, path)
    names = lines[0].split() if header else [f"_c{i}" for i in range(len(lines[0].split()))]
    rows = text.where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    df = rows.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    # a column is numeric when every value of it is a number
    numeric = df.agg(*[F.bool_and(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").try_cast("double").isNotNull()).alias(n) for n in names]).first()
    return df.select(*[F.col(f"`{n}`").cast("double").alias(n) if numeric[i] else F.col(f"`{n}`") for i, n in enumerate(names)])


def scan_limit(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows for a preflight look; no full scan."""
    return df.limit(rows)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
