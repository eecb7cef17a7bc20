"""Reading a directory of Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def load_tables(spark: SparkSession, directory: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """One DataFrame per table from ``<directory>/<name>.parquet``.

    A missing path raises Spark's own path-not-found error.
    """
    base = directory.rstrip("/")
    return {
        name: spark.read.schema(schema).parquet(f"{base}/{name}.parquet")
        for name, schema in schemas.items()
    }
