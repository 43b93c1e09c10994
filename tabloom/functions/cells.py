"""Cell-level expressions. All stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
_TWO53 = float(1 << 53)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Give every float column one kind of missing value."""
    fixes = {f.name: finite(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, FLOATS)}
    return df.withColumns(fixes) if fixes else df


def uniform(*parts: Column | str | int, seed: int = 42) -> Column:
    """Number in [0,1) that depends on the row key and the seed only, not on partitions."""
    cols = [p if isinstance(p, Column) else (F.col(p) if isinstance(p, str) else F.lit(p)) for p in parts]
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / F.lit(_TWO53)


def normal(*parts: Column | str | int, seed: int = 42) -> Column:
    """Standard normal from two hashed uniforms (Box and Muller)."""
    u1 = F.greatest(uniform(*parts, seed=seed), F.lit(1e-300))
    u2 = uniform(*parts, seed=seed + 7919)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)


def row_hash(columns: Iterable[str]) -> Column:
    """md5 of all named columns as text, the same in any SQL engine."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *texts))


def hash_bucket100(key_hash: Column) -> Column:
    """0..99 from the first eight hex digits."""
    return F.conv(F.substring(key_hash, 1, 8), 16, 10).cast("bigint") % 100


def pandas_dtype(dtype: T.DataType) -> str:
    """dtype name the profiled column has as a pandas series."""
    # Spark type name to pandas dtype name.
    names = {
        "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8",
        "double": "float64", "float": "float32", "string": "object", "boolean": "bool",
        "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "object",
    }
    return names.get(dtype.simpleString(), "object")


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def round_exact(c: Column, digits: int = 2) -> Column:
    """Round by the exact binary value, half to even, as Python does.

    The product with a power of ten is rounded itself; splitting the number gives the
    part lost there, which decides the seeming ties.
    """
    s = float(10 ** digits)
    x = c.cast("double")
    p = x * s
    t = x * F.lit(float((1 << 27) + 1))
    high = t - (t - x)
    lost = (high * s - p) + (x - high) * s
    low = F.floor(p)
    tie = (p - low) == 0.5
    whole = F.when(tie & (lost > 0), low + 1).when(tie & (lost < 0), low).when(tie, F.bround(p, 0)).otherwise(F.floor(p + 0.5))
    return whole / s


# Number syntax, also used per white-space part.
NUMBER_PATTERN = r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?$"


def is_numeric_like(text: Column) -> Column:
    """A number, or several words of which at least 80 % are numbers."""
    clean = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    parts = F.split(clean, r"\s+")
    hits = F.size(F.filter(parts, lambda p: p.rlike(NUMBER_PATTERN)))
    several = (F.size(parts) > 1) & (hits / F.size(parts) >= 0.8)
    return F.coalesce((clean != "") & (clean.rlike(NUMBER_PATTERN) | several), F.lit(False))


# Formats tried for text dates, in this order.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd",
    "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd",
)


def parse_timestamp(c: Column) -> Column:
    """First format that fits, else NULL."""
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries, c.try_cast("timestamp"))
