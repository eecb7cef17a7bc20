"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings. Adaptive execution splits skewed join partitions (a track or a
# customer holding a large share of the rows) and may add a shuffle to do so.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Where every partition of the smaller side stays under this size, hash it instead
    # of sorting both sides. Checked at run time on the shuffled sizes, which are
    # compressed; hash tables do not spill, so this stays far below a task's memory.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that the session leaves open. What its owner has set stays.

    Parallelism is the cluster's choice.
    """
    chosen = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark
