"""Cohort retention, retention decay, and the dense cohort grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesmart.functions.dates import DataRange, DateRange, month_of, months_apart
from salesmart.operators.staging import first_purchases
from salesmart.sources.model import SalesModel


def cohort_activity(
    staged: DataFrame, model: SalesModel, rng: DateRange | DataRange, max_offset: int | None = None
) -> DataFrame:
    """Active customers per cohort month and month offset, offset 0 included.

    Cohorts come from all invoices, activity from the staged set in range. Without
    ``max_offset`` the span of staged months is the limit. ``num_first`` counts each
    customer once, at the first active month.
    """
    rows = staged if max_offset is None else staged.where(rng.contains("dt"))
    monthly = rows.groupBy("customer_id", month_of("dt").alias("activity_month")).agg(
        F.max(rng.contains("dt")).alias("active")
    )
    cohort = first_purchases(model.invoice).select(
        "customer_id", month_of("first_date").alias("cohort_month")
    )
    active_month = F.when(F.col("active"), F.col("activity_month"))
    # One row per customer and calendar month.
    first_active = F.min(active_month).over(Window.partitionBy("customer_id"))
    grid = (
        monthly.join(cohort, "customer_id")
        .withColumn("is_first", active_month == first_active)
        .groupBy("cohort_month", "activity_month")
        .agg(F.count_if("active").alias("num_active"), F.count_if("is_first").alias("num_first"))
    )
    offsets = grid.withColumn("month_offset", months_apart("cohort_month", "activity_month"))
    if max_offset is None:
        # The grid is at most calendar months squared, so one task can hold it.
        everything = Window.partitionBy()
        limit = months_apart(
            F.min("activity_month").over(everything), F.max("activity_month").over(everything)
        )
    else:
        limit = F.lit(max_offset)
    return (
        offsets.withColumn("limit", limit)
        .where("num_active > 0 AND month_offset BETWEEN 0 AND limit")
        .select("cohort_month", "month_offset", "num_active", "num_first")
    )


def cohort_retention(
    staged: DataFrame, model: SalesModel, rng: DateRange | DataRange, max_offset: int | None = None
) -> DataFrame:
    """Share of each cohort active at each month offset after the first month."""
    sizes = (
        first_purchases(model.invoice)
        .groupBy(month_of("first_date").alias("cohort_month"))
        .agg(F.count(F.lit(1)).alias("cohort_size"))
    )
    share = F.col("num_active").cast("double") / F.col("cohort_size")
    return (
        cohort_activity(staged, model, rng, max_offset)
        .where("month_offset > 0")
        .join(sizes, "cohort_month")
        .select(
            "cohort_month",
            "month_offset",
            F.col("num_active").alias("num_active_customers"),
            "cohort_size",
            F.round(share, 4).alias("retention_pct"),
        )
    )


def retention_decay(
    staged: DataFrame, model: SalesModel, rng: DateRange | DataRange, max_offset: int | None = None
) -> DataFrame:
    """Share of the customers active in range who buy at each month offset."""
    by_offset = (
        cohort_activity(staged, model, rng, max_offset)
        .groupBy("month_offset")
        .agg(F.sum("num_active").alias("num_retained"), F.sum("num_first").alias("num_first"))
    )
    # One row per offset: calendar months bound this window.
    everyone = F.sum("num_first").over(Window.partitionBy())
    return (
        by_offset.withColumn("num_customers", everyone)
        .where("month_offset > 0")
        .select(
            "month_offset",
            "num_retained",
            "num_customers",
            (F.col("num_retained").cast("double") / F.col("num_customers")).alias("retention_rate"),
        )
    )


def decay_percent(decay: DataFrame) -> DataFrame:
    """The decay curve in percent."""
    return decay.withColumn("retention_rate", F.col("retention_rate") * 100)


def top_cohorts(cohorts: DataFrame, offsets: Sequence[int] = (3, 6, 9)) -> DataFrame:
    """Best cohort at each offset, earliest month on ties; null where no cohort reached it."""
    order = Window.partitionBy("month_offset").orderBy(F.desc("retention_pct"), F.asc("cohort_month"))
    best = (
        cohorts.where(F.col("month_offset").isin(*offsets) & F.col("retention_pct").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .select("month_offset", "cohort_month", "retention_pct")
    )
    wanted = cohorts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(o) for o in offsets])).alias("month_offset")
    )
    return wanted.join(best, "month_offset", "left").orderBy("month_offset")


def cohort_grid(cohorts: DataFrame) -> DataFrame:
    """Every cohort month by every offset between the extremes seen, in percent.

    Cells without activity are null. Months of the calendar bound the grid.
    """
    ends = cohorts.agg(
        F.min("cohort_month").alias("first_month"),
        F.max("cohort_month").alias("last_month"),
        F.min("month_offset").alias("low"),
        F.max("month_offset").alias("high"),
    )
    cells = ends.select(
        F.explode(F.expr("sequence(first_month, last_month, interval 1 month)")).alias("cohort_month"),
        "low",
        "high",
    ).select("cohort_month", F.explode(F.sequence("low", "high")).alias("month_offset"))
    return (
        cells.join(cohorts, ["cohort_month", "month_offset"], "left")
        .select(
            "cohort_month",
            "month_offset",
            F.date_format("cohort_month", "MMM yyyy").alias("cohort_label"),
            "num_active_customers",
            "cohort_size",
            (F.col("retention_pct") * 100).alias("retention_pct"),
        )
        .orderBy("cohort_month", "month_offset")
    )


def cohort_matrix(grid: DataFrame) -> DataFrame:
    """The grid as one row per cohort in time order, with all its offsets in an array.

    ``offsets`` and ``retention_pct`` run side by side, from the least to the greatest
    offset of the data, so no column has to be known beforehand and none can be missing.
    """
    cells = F.array_sort(F.collect_list(F.struct("month_offset", "retention_pct")))
    wide = grid.groupBy("cohort_month", "cohort_label").agg(cells.alias("cells"))
    return wide.select(
        "cohort_month",
        "cohort_label",
        F.col("cells.month_offset").alias("offsets"),
        F.col("cells.retention_pct").alias("retention_pct"),
    ).orderBy("cohort_month")
