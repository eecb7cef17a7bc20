"""CSV sink for result grids."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame


def export_csv(
    df: DataFrame, directory: str, name: str, prefix: str = "sales", day: date | None = None
) -> str | None:
    """Write ``<directory>/<prefix>_<name>_<YYYY_MM_DD>.csv`` with a header.

    The target is a folder of part files, written in parallel. An empty result writes
    nothing and returns None. The frame is cached while it is tested and written, so
    its plan runs once.
    """
    stamp = (day or date.today()).strftime("%Y_%m_%d")
    target = f"{directory.rstrip('/')}/{prefix}_{name}_{stamp}.csv"
    df = df.persist()
    try:
        if df.isEmpty():
            return None
        df.write.mode("overwrite").option("header", True).csv(target)
        return target
    finally:
        df.unpersist()
