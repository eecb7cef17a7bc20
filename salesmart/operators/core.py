"""Core KPIs of a staged set over a date range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import DataRange, DateRange
from salesmart.functions.money import HIGH, LOW, revenue, sum_revenue
from salesmart.functions.ratios import ratio
from salesmart.functions.rows import first_per, fold_rows
from salesmart.operators.staging import first_purchases, sold_tracks
from salesmart.sources.model import SalesModel

# KPI names in order, with how each is displayed.
CORE_KPIS = {
    "purchases_num": "number",
    "cust_num": "number",
    "cust_num_new": "number",
    "cust_per_new": "percent",
    "tracks_sold_num": "number",
    "tracks_per_purchase": "float",
    "revenue_total": "dollar",
    "revenue_per_month": "dollar",
    "revenue_per_cust": "dollar",
    "revenue_per_purchase": "dollar",
    "genre_num": "number",
    "artist_num": "number",
    "country_num": "number",
}


def core_kpis(staged: DataFrame, model: SalesModel, rng: DateRange | DataRange) -> DataFrame:
    """One row of KPIs over the month-aligned range; no row when it holds no invoice.

    New customers are those whose first purchase of all, staged or not, falls in range.
    """
    window = rng.month_aligned()
    inside = staged.where(window.contains("dt"))
    return (
        fold_rows(_spending(inside, model, window), _breadth(inside, model))
        .where("purchases_num > 0")
        .select(
            "purchases_num",
            "cust_num",
            "cust_num_new",
            ratio("cust_num_new", "cust_num").alias("cust_per_new"),
            "tracks_sold_num",
            ratio("tracks_sold_num", "purchases_num").alias("tracks_per_purchase"),
            "revenue_total",
            (F.col("revenue_total") / window.months).alias("revenue_per_month"),
            ratio("revenue_total", "cust_num").alias("revenue_per_cust"),
            ratio("revenue_total", "purchases_num").alias("revenue_per_purchase"),
            "genre_num",
            "artist_num",
            "country_num",
        )
    )


def total_revenue(staged: DataFrame, rng: DateRange | None) -> DataFrame:
    """One row, one column: revenue in cents precision over the month-aligned range."""
    inside = staged.where(rng.month_aligned().contains("dt")) if rng else staged
    return inside.agg(*sum_revenue()).select(_in_cents().alias("total"))


def _spending(inside: DataFrame, model: SalesModel, window: DateRange | DataRange) -> DataFrame:
    # Down to customer and country, then to country: every figure adds up on the way.
    spend = inside.groupBy(*model.customer_keys).agg(
        F.count(F.lit(1)).alias("purchases"),
        F.sum("tracks_sold").alias("tracks_sold"),
        *sum_revenue(),
    )
    first = first_purchases(model.invoice).where(window.contains("first_date"))
    new = first.select("customer_id", F.lit(True).alias("is_new"))
    per_country = (
        model.with_country(spend.join(new, "customer_id", "left"))
        .withColumn("counts", first_per(["customer_id"], "country"))
        .groupBy("country")
        .agg(
            F.sum("purchases").alias("purchases"),
            F.count_if("counts").alias("customers"),
            F.count_if(F.col("counts") & F.col("is_new")).alias("new_customers"),
            F.sum("tracks_sold").alias("tracks_sold"),
            *sum_revenue(),
        )
    )
    totals = per_country.agg(
        F.sum("purchases").alias("purchases_num"),
        F.sum("customers").alias("cust_num"),
        F.sum("new_customers").alias("cust_num_new"),
        F.coalesce(F.sum("tracks_sold"), F.lit(0)).alias("tracks_sold_num"),
        F.count("country").alias("country_num"),
        *sum_revenue(),
    )
    return totals.withColumn("revenue_total", _in_cents()).drop(HIGH, LOW)


def _in_cents() -> Column:
    return F.round(F.coalesce(revenue(), F.lit(0)), 2).cast("double")


def _breadth(inside: DataFrame, model: SalesModel) -> DataFrame:
    sold = sold_tracks(model, inside).join(model.item, "track_id")
    return (
        sold.select("genre_id", "artist_id")
        .distinct()
        .agg(
            F.count_distinct("genre_id").alias("genre_num"),
            F.count_distinct("artist_id").alias("artist_num"),
        )
    )

