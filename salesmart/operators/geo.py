"""Country metrics per year and over the whole range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesmart.functions.countries import resolve_country
from salesmart.functions.dates import DataRange, DateRange
from salesmart.sources.model import SalesModel
from salesmart.functions.money import revenue, sum_revenue
from salesmart.functions.rows import record, unpivot
from salesmart.operators.metrics import METRICS, check_metric

# Fixed value: the year label of rows over the whole range.
ALL_YEARS = "All"

MODES = {"yearly": (False, True), "aggregate": (True, False), "frames": (True, True)}


def geo_metrics(
    staged: DataFrame, model: SalesModel, rng: DateRange | DataRange, mode: str = "yearly"
) -> DataFrame:
    """KPIs per country and year ("yearly"), over all years ("aggregate"), or both ("frames").

    A customer is a first-timer where the first purchase day in range falls. For "frames"
    the few rows that are left per customer go to their year and to the total.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    whole, yearly = MODES[mode]
    # A null year stands for all years until the end.
    year = F.year("dt") if yearly else F.lit(None).cast("int")
    inside = staged.where(rng.contains("dt"))
    spend = inside.groupBy(*model.customer_keys, year.alias("year")).agg(
        F.count(F.lit(1)).alias("num_purchases"),
        F.sum("tracks_sold").alias("tracks_sold"),
        *sum_revenue(),
        F.min("dt").alias("first_here"),
    )
    if whole and yearly:
        both = F.explode(F.array(F.lit(None).cast("int"), F.col("year")))
        spend = (
            spend.withColumn("year", both)
            .groupBy(*model.customer_keys, "year")
            .agg(
                F.sum("num_purchases").alias("num_purchases"),
                F.sum("tracks_sold").alias("tracks_sold"),
                *sum_revenue(),
                F.min("first_here").alias("first_here"),
            )
        )
    per_customer = model.with_country(spend)
    # Years times countries bound the rows per customer in this window.
    first = F.min("first_here").over(Window.partitionBy("customer_id"))
    return (
        per_customer.withColumn("is_first", F.col("first_here") == first)
        .groupBy("year", "country")
        .agg(
            F.count("customer_id").alias("num_customers"),
            F.sum("num_purchases").alias("num_purchases"),
            F.sum("tracks_sold").alias("tracks_sold"),
            *sum_revenue(),
            F.count_if("is_first").alias("first_time_customers"),
        )
        .select(
            F.coalesce(F.col("year").cast("string"), F.lit(ALL_YEARS)).alias("year"),
            F.when(F.col("year").isNull(), F.lit(rng.full_months))
            .otherwise(rng.months_of_year(F.col("year")))
            .alias("num_months"),
            "country",
            "num_customers",
            "num_purchases",
            "tracks_sold",
            revenue().cast("double").alias("revenue"),
            "first_time_customers",
        )
    )


def with_iso3(geo: DataFrame, countries: DataFrame) -> DataFrame:
    """Add ``iso_alpha`` from a country dimension; unresolved countries drop out."""
    known = countries.where(F.col("iso3").isNotNull()).withColumn("iso_alpha", F.col("iso3"))
    return resolve_country(geo, "country", known, "inner", "iso_alpha")


def metric_bounds(df: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Smallest and largest value of each metric over all rows, one row per metric."""
    checked = [check_metric(m) for m in metrics]
    ends = df.agg(
        *[F.min(m).cast("double").alias(f"low_{m}") for m in checked],
        *[F.max(m).cast("double").alias(f"high_{m}") for m in checked],
    )
    return unpivot(
        ends,
        [record(metric=m, min_value=F.col(f"low_{m}"), max_value=F.col(f"high_{m}")) for m in checked],
    )
