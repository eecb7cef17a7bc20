"""Genre, artist and country performance, catalog coverage and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.functions.countries import resolve_country
from salesmart.functions.dates import DataRange, DateRange, within
from salesmart.functions.display import country_label, display
from salesmart.functions.money import revenue, sum_revenue
from salesmart.functions.ratios import ratio
from salesmart.functions.rows import record
from salesmart.operators.metrics import METRICS, check_metric
from salesmart.operators.staging import group_sales, sold_tracks
from salesmart.sources.model import SalesModel

GROUPS = ("genre", "artist", "country")
CATALOGED = ("genre", "artist")


def group_kpis(
    staged: DataFrame, model: SalesModel, by: str, rng: DateRange | None = None
) -> DataFrame:
    """One row per genre, artist or country over the month-aligned range.

    A customer is a first-timer of every group bought on the customer's first day
    within this very selection.
    """
    _check(by, GROUPS)
    inside = staged.where(within(rng.month_aligned() if rng else None, "dt"))
    # One row per invoice and group, so rows count as purchases.
    figures = [
        F.count(F.lit(1)).alias("num_purchases"),
        F.sum("tracks_sold").alias("tracks_sold"),
        *sum_revenue(),
        F.min("dt").alias("first_in_group"),
    ]
    if by == "country":
        spend = inside.groupBy(*model.customer_keys).agg(*figures)
        per_customer = model.with_country(spend).withColumnRenamed("country", "group_val")
    else:
        per_customer = group_sales(model, inside, by).groupBy("customer_id", "group_val").agg(*figures)
    # At most one row per group and customer enters this window.
    first = F.min("first_in_group").over(Window.partitionBy("customer_id"))
    return (
        per_customer.withColumn("is_first", F.col("first_in_group") == first)
        .groupBy("group_val")
        .agg(
            F.count("customer_id").alias("num_customers"),
            F.sum("num_purchases").alias("num_purchases"),
            F.sum("tracks_sold").alias("tracks_sold"),
            *sum_revenue(),
            F.count_if("is_first").alias("first_time_customers"),
        )
        .select(
            "group_val",
            "num_customers",
            "num_purchases",
            "tracks_sold",
            revenue().cast("double").alias("revenue"),
            "first_time_customers",
        )
    )


def catalog(model: SalesModel, by: str) -> DataFrame:
    """Catalog size per genre or artist."""
    _check(by, CATALOGED)
    return (
        model.item.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.count("track_id").alias("num_tracks"))
        .orderBy(by)
    )


def catalog_sales(
    staged: DataFrame, model: SalesModel, by: str, rng: DateRange | None = None
) -> DataFrame:
    """Distinct tracks sold per genre or artist against its catalog size."""
    _check(by, CATALOGED)
    inside = staged.where(within(rng.month_aligned() if rng else None, "dt"))
    groups = model.item.where(F.col(by).isNotNull()).select("track_id", F.col(by).alias("group_val"))
    sold = (
        sold_tracks(model, inside)
        .join(groups, "track_id")
        .groupBy("group_val")
        .agg(F.count(F.lit(1)).alias("unique_tracks_sold"))
    )
    return (
        sold.join(_catalog_sizes(model, by), "group_val", "left")
        .withColumn("pct_catalog_sold", ratio("unique_tracks_sold", "catalog_size"))
    )


def group_yearly(staged: DataFrame, model: SalesModel, by: str, rng: DateRange | DataRange) -> DataFrame:
    """Yearly performance per genre or artist, with firsts judged by year.

    Customers and tracks are counted in separate branches, each reduced to its own grain
    before the shuffle, instead of one multi-distinct pass that copies every line.
    """
    _check(by, CATALOGED)
    inside = staged.where(rng.contains("dt"))
    keys = ["year", "group_val"]
    return (
        _yearly_customers(group_sales(model, inside, by), model)
        .join(_yearly_tracks(model, inside, by), keys)
        .join(_catalog_sizes(model, by), "group_val", "left")
        .select(
            F.col("year").cast("string").alias("year"),
            F.col("group_val").alias(by),
            "num_customers",
            "num_purchases",
            "num_countries",
            "tracks_sold",
            revenue().cast("double").alias("revenue"),
            "first_time_customers",
            "unique_tracks_sold",
            "first_tracks_sold",
            "catalog_size",
        )
    )


def _yearly_customers(sales: DataFrame, model: SalesModel) -> DataFrame:
    spend = sales.groupBy(*model.customer_keys, F.year("dt").alias("year"), "group_val").agg(
        F.count(F.lit(1)).alias("num_purchases"),
        F.sum("tracks_sold").alias("tracks_sold"),
        *sum_revenue(),
    )
    per_customer = model.with_country(spend)
    # Few rows per customer are left: years times groups times countries. In this order
    # the first row holds the first year, and a customer is counted on the first country
    # of each year and group, so that the count adds up over countries.
    in_time = Window.partitionBy("customer_id").orderBy("year", "group_val", "country")
    first_year = F.first("year").over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    here, before = F.struct("year", "group_val"), F.lag(F.struct("year", "group_val")).over(in_time)
    per_country = (
        per_customer.select(
            "*",
            (~here.eqNullSafe(before)).alias("counts"),
            (F.col("year") == first_year).alias("is_first"),
        )
        .groupBy("year", "group_val", "country")
        .agg(
            F.count_if("counts").alias("num_customers"),
            F.sum("num_purchases").alias("num_purchases"),
            F.sum("tracks_sold").alias("tracks_sold"),
            *sum_revenue(),
            F.count_if(F.col("counts") & F.col("is_first")).alias("first_time_customers"),
        )
    )
    return per_country.groupBy("year", "group_val").agg(
        F.sum("num_customers").alias("num_customers"),
        F.sum("num_purchases").alias("num_purchases"),
        F.count("country").alias("num_countries"),
        F.sum("tracks_sold").alias("tracks_sold"),
        *sum_revenue(),
        F.sum("first_time_customers").alias("first_time_customers"),
    )


def _yearly_tracks(model: SalesModel, inside: DataFrame, by: str) -> DataFrame:
    groups = model.item.where(F.col(by).isNotNull()).select("track_id", F.col(by).alias("group_val"))
    sold = sold_tracks(model, inside.withColumn("year", F.year("dt")), "year")
    # One row per track and year.
    first_year = F.min("year").over(Window.partitionBy("track_id"))
    return (
        sold.withColumn("is_first", F.col("year") == first_year)
        .join(groups, "track_id")
        .groupBy("year", "group_val")
        .agg(
            F.count(F.lit(1)).alias("unique_tracks_sold"),
            F.count_if("is_first").alias("first_tracks_sold"),
        )
    )


def yearly_ratios(yearly: DataFrame) -> DataFrame:
    """Revenue per catalog track and share of the catalog sold, per year and group."""
    return yearly.withColumns(
        {
            "revenue_per_track": ratio("revenue", "catalog_size"),
            "pct_catalog_sold": ratio("unique_tracks_sold", "catalog_size"),
        }
    )


def top_groups_yearly(yearly: DataFrame, by: str, metric: str = "revenue", n: int = 20) -> DataFrame:
    """Yearly rows of the ``n`` groups with the largest metric over all years.

    Each group's rows, one per year, ride along while the totals are ranked, so the
    yearly result is computed once.
    """
    check_metric(metric)
    return (
        yearly.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.sum(metric).alias("grand_total"),
            F.collect_list(F.struct(*yearly.columns)).alias("years"),
        )
        .orderBy(F.desc("grand_total"), by)
        .limit(n)
        .select(F.inline("years"))
        .orderBy("year", by)
    )


def top_n(groups: DataFrame, n: int = 5, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """The best ``n`` groups for each metric, ties by name, as ``metric, rank, ...``.

    All metrics are ranked in one pass; Spark keeps only ``n`` rows per metric and task
    before the shuffle.
    """
    pairs = F.array(
        *[record(metric=check_metric(m), metric_value=F.col(m).cast("double")) for m in metrics]
    )
    order = Window.partitionBy("metric").orderBy(F.desc("metric_value"), F.asc_nulls_last("group_val"))
    return (
        groups.select(F.inline(pairs), "*")
        .where(F.col("metric_value").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .drop("metric_value")
    )


def enrich_top_n(
    top: DataFrame, total: Column | None = None, coverage: DataFrame | None = None
) -> DataFrame:
    """Add averages, revenue share and, given ``coverage``, catalog figures.

    The share is of ``total``; without a positive total, of the slice itself.
    """
    slice_sum = F.sum("revenue").over(Window.partitionBy("metric"))
    base = slice_sum if total is None else F.when(total > 0, total).otherwise(slice_sum)
    enriched = top.withColumns(
        {
            "avg_revenue_per_cust": ratio("revenue", "num_customers"),
            "avg_revenue_per_purchase": ratio("revenue", "num_purchases"),
            "avg_tracks_per_purchase": ratio("tracks_sold", "num_purchases"),
            "revenue_share": ratio(F.col("revenue"), base),
        }
    )
    return enriched if coverage is None else enriched.join(coverage, "group_val", "left")


# How each ranked column is displayed.
TOP_N_DISPLAY = {
    "num_customers": "number",
    "num_purchases": "number",
    "tracks_sold": "number",
    "revenue": "dollar",
    "first_time_customers": "number",
    "avg_revenue_per_cust": "dollar",
    "avg_revenue_per_purchase": "dollar",
    "avg_tracks_per_purchase": "float",
    "revenue_share": "percent",
    "unique_tracks_sold": "number",
    "catalog_size": "number",
    "pct_catalog_sold": "percent",
}


def display_top_n(top: DataFrame, countries: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Add a ``*_fmt`` text column for every figure and for the group name.

    ``countries``, a country dimension with iso2, iso3 and label, turns countries into flag
    and label, or flag and code with ``label="iso3"``; without it names are shown as they
    are.
    """
    texts = {f"{c}_fmt": display(c, kind) for c, kind in TOP_N_DISPLAY.items() if c in top.columns}
    if countries is None:
        return top.withColumns({**texts, "group_val_fmt": F.col("group_val")})
    return (
        resolve_country(top, "group_val", countries, "left", "iso2", label)
        .withColumns({**texts, "group_val_fmt": country_label("iso2", label)})
        .drop("iso2", label)
    )


def _catalog_sizes(model: SalesModel, by: str) -> DataFrame:
    return (
        model.item.where(F.col(by).isNotNull())
        .groupBy(F.col(by).alias("group_val"))
        .agg(F.count("track_id").alias("catalog_size"))
    )


def _check(by: str, allowed: Sequence[str]) -> None:
    if by not in allowed:
        raise ValueError(f"group must be one of {', '.join(allowed)}, not {by!r}")
