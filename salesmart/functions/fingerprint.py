"""Order-free fingerprints of a key set or of a whole frame.

Each row is hashed on its own and the hashes are summed, so the state is two numbers
per task whatever the row count. A digest of the sorted, joined keys would need them
all in one task; this one identifies the same set with mergeable state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a null and a field boundary enter the hashed text.
NULL_TEXT = "~"
FIELD_BREAK = "|"


def key_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """One row: number of distinct keys and their fingerprint; duplicates do not count."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return _digest(keys.select(F.col(key).cast("string").alias("text")))


def frame_fingerprint(df: DataFrame, scale: int = 6) -> DataFrame:
    """One row: number of rows and a fingerprint of all columns, ``scale`` decimals kept."""
    fields = [_as_text(f, scale) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return _digest(df.select(F.concat_ws(FIELD_BREAK, *fields).alias("text")))


def _as_text(field: T.StructField, scale: int) -> Column:
    col = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        col = F.round(col, scale).cast(T.DecimalType(38, scale))
    return F.coalesce(col.cast("string"), F.lit(NULL_TEXT))


def _digest(texts: DataFrame) -> DataFrame:
    hashed = texts.select(F.md5("text").alias("h"))
    total = F.coalesce(F.sum(_hex_to_decimal(F.col("h"), 1)), F.lit(0))
    other = F.coalesce(F.sum(_hex_to_decimal(F.col("h"), 16)), F.lit(0))
    joined = F.concat_ws("-", F.count(F.lit(1)).cast("string"), total.cast("string"), other.cast("string"))
    return hashed.agg(F.count(F.lit(1)).alias("num_keys"), F.md5(joined).alias("fingerprint"))


def _hex_to_decimal(digest: Column, start: int) -> Column:
    """Fifteen hex digits (60 bits) as an exact number."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")
