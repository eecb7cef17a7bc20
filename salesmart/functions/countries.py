"""Resolving country names and codes through a country dimension.

The dimension has a row per country: ``country`` (the name), ``iso2``, ``iso3`` and
``label``, the last three as far as needed. A value matches by name or by either code,
whatever its case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "country_key"


def resolve_country(df: DataFrame, column: str, countries: DataFrame, how: str, *wanted: str) -> DataFrame:
    """Join ``wanted`` columns of the dimension onto ``df`` by the country in ``column``.

    Every key resolves to one row, so the join never repeats rows of ``df``.
    """
    spellings = [F.upper(c) for c in ("country", "iso2", "iso3") if c in countries.columns]
    keys = (
        countries.select(F.explode(F.array_distinct(F.array(*spellings))).alias(KEY), *wanted)
        .where(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(F.max(F.struct(*wanted)).alias("found"))
        .select(KEY, "found.*")
    )
    return df.withColumn(KEY, F.upper(column)).join(keys, KEY, how).drop(KEY)
