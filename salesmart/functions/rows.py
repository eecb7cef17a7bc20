"""Helpers on frames of a single row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_rows(*rows: DataFrame) -> DataFrame:
    """Merge one-row frames with different columns into one row.

    A union and a global maximum: no join, and the branches run side by side.
    """
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def first_per(keys: list[str], order: str) -> Column:
    """True on one row per key, so that counting it counts distinct keys.

    Meant for rows already reduced to a few per key; the flag then adds up under any
    coarser grouping, where a distinct count would have to copy the rows.
    """
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1


def record(**fields: Column | str | int | None) -> Column:
    """A struct of named fields; plain values become literals."""
    return F.struct(
        *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]
    )


def unpivot(row: DataFrame, records: list[Column]) -> DataFrame:
    """One output row per record."""
    return row.select(F.inline(F.array(*records)))


def rename_values(col: str, names: Mapping[str, str]) -> Column:
    """Replace known values by their names, others by null."""
    known = [part for pair in names.items() for part in pair]
    return F.create_map(*[F.lit(part) for part in known])[F.col(col)]
