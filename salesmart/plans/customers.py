"""Customer state that grows by days, without reading old invoices again.

What boundaries, gaps and lifespans need of a customer's past is the number of purchases on
each day. These add up, so they are kept in batches: a batch holds those of the invoices that
came in together, new days as a rule, and later ones for a day that is already there too. A
batch is known by a name, and writing it again replaces it, so a run that is repeated counts
nothing twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.dates import DateRange
from salesmart.operators.retention import bounds_of_days, customer_metrics, daily_purchases

SCHEMA = "customer_id long, dt date, n long"


@dataclass(frozen=True)
class CustomerDays:
    """Batches below a folder."""

    folder: str

    def add(self, batch: str, staged: DataFrame) -> None:
        """Write the purchases of staged invoices as a batch."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named by letters, digits, dots, dashes and underscores")
        days = daily_purchases(staged).select(F.col("customer_id").cast("long"), "dt", "n")
        days.write.mode("overwrite").parquet(f"{self.folder.rstrip('/')}/batch={batch}")

    def merge(self, batch: str, folder: str) -> CustomerDays:
        """All batches as a single one in a new folder, once they are many."""
        spark = SparkSession.active()
        self.daily(spark).write.parquet(f"{folder.rstrip('/')}/batch={batch}")
        return CustomerDays(folder)

    def daily(self, spark: SparkSession) -> DataFrame:
        """customer_id, dt and the number of purchases of the day over all batches."""
        read = spark.read.schema(SCHEMA + ", batch string").parquet(self.folder)
        return read.groupBy("customer_id", "dt").agg(F.sum("n").alias("n"))

    def bounds(self, spark: SparkSession, rng: DateRange | None = None) -> DataFrame:
        """The same as ``customer_bounds`` over all invoices of all batches."""
        return bounds_of_days(self.daily(spark), rng)

    def metrics(self, spark: SparkSession, rng: DateRange | None = None, strict: bool = False) -> DataFrame:
        return customer_metrics(self.bounds(spark, rng), rng, strict)
