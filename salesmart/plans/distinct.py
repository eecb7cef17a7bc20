"""Distinct customers and tracks of a group over any range, from bitmaps kept per period.

A distinct count can't be added up over days; a set can. For every day and group the ids are
kept as bitmaps, in buckets of 32768 ids, and months as the union of their days. A range is the
union of its whole months and of the days at its ends, so it reads a few rows per month and
group, no line and no invoice. Counts are exact. Ids are whole numbers.

Of a bitmap only the words that hold an id are kept, each with its place: a set takes as much
room as it has ids, and no more than two bitmaps where it is full. Words are united by hash and
without sorting, those of one bucket in different tasks.

One set after the other is written, so that no more than one is shuffled at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.dates import DateRange, month_of
from salesmart.operators.groups import CATALOGED, GROUPS
from salesmart.operators.staging import group_sales, sold_tracks
from salesmart.plans.mart import SalesMart
from salesmart.sources.layout import sold_by_invoice
from salesmart.sources.shared import settings

COUNTED = {"customer": "num_customers", "track": "unique_tracks_sold"}
#: While sets are written: shuffle files go with the write that made them, not whenever the driver
#: collects its garbage, and words are collected into sets in the order they are written in.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    "spark.sql.parquet.compression.codec": "zstd",
}
#: A word is a long: 32 bits of the bitmap, and above them its place among the words of the bucket.
WORD_BITS = 32


@dataclass(frozen=True)
class DistinctSets:
    """Bitmaps below a folder, by genre, artist and country."""

    folder: str

    def write(self, mart: SalesMart) -> None:
        """Of all staged invoices, into a new folder."""
        spark = mart.model.invoice.sparkSession
        with settings(spark, WRITING), sold_by_invoice(mart._sold(None), mart.invoices, f"{self.folder.rstrip('/')}/sold") as held:
            sold = SalesMart(held[0], mart.filter, held[1])
            for by in GROUPS:
                for kind in COUNTED if by in CATALOGED else ("customer",):
                    own = f"by={by}/kind={kind}"
                    _write(_day_sets(_members(sold, by, kind)), f"{self._path('day')}/{own}")
                    days = spark.read.schema(_SET).parquet(f"{self._path('day')}/{own}")
                    _write(_month_sets(days), f"{self._path('month')}/{own}")

    def counts(self, spark: SparkSession, by: str, rng: DateRange | None = None) -> DataFrame:
        """group_val and the number of distinct customers and, but for countries, of tracks."""
        chosen = self._read(spark, "month")
        if rng is not None:
            whole, ends = rng.whole_months(), rng.contains("period")
            if whole is not None:
                ends = ends & ~whole.contains("period")
            chosen = chosen.where(F.lit(False) if whole is None else whole.contains("period"))
            chosen = chosen.unionByName(self._read(spark, "day").where(ends))
        united = _united(chosen.where(F.col("by") == by), "kind", "group_val", "bucket")
        kinds = COUNTED if by in CATALOGED else ("customer",)
        held = F.bit_count(F.col("word").bitwiseAND(F.lit((1 << WORD_BITS) - 1)))
        sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, held)), F.lit(0)).alias(COUNTED[k]) for k in kinds]
        return united.groupBy("group_val").agg(*sums)

    def _path(self, grain: str) -> str:
        return f"{self.folder.rstrip('/')}/{grain}_words"

    def _read(self, spark: SparkSession, grain: str) -> DataFrame:
        return spark.read.schema(f"{_SET}, `by` string, kind string").parquet(self._path(grain))


_KEYS = ("period", "group_val", "bucket")
_SET = "group_val string, period date, bucket long, words array<long>"


def _members(mart: SalesMart, by: str, kind: str) -> DataFrame:
    """group_val, dt and id, once each: an id may have a large share of the invoices or lines."""
    if kind == "track":
        sold = sold_tracks(mart.model, mart.invoices, "dt", labels=(by,)).where(F.col(by).isNotNull())
        return sold.select(F.col(by).alias("group_val"), "dt", F.col("track_id").alias("id"))
    if by == "country":
        # Customers and days first: one customer may have a large share of the invoices.
        own = mart.invoices.select(*mart.model.customer_keys, "dt").distinct()
        return mart.model.with_country(own).select(F.col("country").alias("group_val"), "dt", F.col("customer_id").alias("id"))
    return group_sales(mart.model, mart.invoices, by).select("group_val", "dt", F.col("customer_id").alias("id")).distinct()


def _day_sets(members: DataFrame) -> DataFrame:
    """Dealt out by month and bucket, so that a task has whole sets of a bounded number of rows."""
    month, bucket = month_of("dt"), F.bitmap_bucket_number("id")
    rows = members.repartition("group_val", month, bucket).select(
        F.col("dt").alias("period"),
        "group_val",
        bucket.alias("bucket"),
        month.alias("month"),
        _word(F.bitmap_bit_position("id")).alias("word"),
    )
    return _sets(rows, *_KEYS, "month").drop("month")


def _month_sets(days: DataFrame) -> DataFrame:
    """Dealt out by bucket: the months of a bucket lie in one file, and are united by its reader."""
    rows = days.repartition("group_val", "bucket").withColumn("period", month_of("period"))
    return _sets(rows.withColumn("word", F.explode_outer("words")), *_KEYS)


def _sets(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per set, of rows with a word each; ids that are null leave an empty one."""
    words = rows.groupBy(*keys, _place()).agg(F.bit_or("word").alias("word"))
    return words.groupBy(*keys).agg(F.sort_array(F.collect_list("word")).alias("words"))


def _united(sets: DataFrame, *keys: str) -> DataFrame:
    """The words of the union, a row each."""
    rows = sets.select(*keys, F.explode_outer("words").alias("word"))
    return rows.groupBy(*keys, _place()).agg(F.bit_or("word").alias("word"))


def _word(position: Column) -> Column:
    """The word that holds one position of a bitmap."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (position % WORD_BITS).cast("int"))
    return F.shiftleft(F.call_function("div", position, F.lit(WORD_BITS)), WORD_BITS).bitwiseOR(bit)


def _place() -> Column:
    return F.shiftright("word", WORD_BITS).alias("place")


def _write(sets: DataFrame, path: str) -> None:
    """In order of periods, so that readers of a few pass over the rest."""
    sets.sortWithinPartitions(*_KEYS).write.parquet(path)
