"""Monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesmart.functions.dates import DataRange, DateRange, month_of
from salesmart.functions.money import revenue, sum_revenue
from salesmart.functions.ratios import ratio


def monthly_summary(staged: DataFrame, rng: DateRange | DataRange) -> DataFrame:
    """KPIs per month; firsts are judged by month over the whole staged history."""
    inside = rng.contains("dt")
    per_customer = staged.groupBy("customer_id", month_of("dt").alias("month")).agg(
        F.count_if(inside).alias("num_purchases"),
        F.sum(F.when(inside, F.col("tracks_sold"))).alias("tracks_sold"),
        *sum_revenue(where=inside),
    )
    # At most one row per calendar month and customer enters this window.
    first_month = F.min("month").over(Window.partitionBy("customer_id"))
    return (
        per_customer.withColumn("is_first", F.col("month") == first_month)
        .where("num_purchases > 0")
        .groupBy(F.date_format("month", "yyyy-MM").alias("month"))
        .agg(
            F.sum("num_purchases").alias("num_purchases"),
            F.count("customer_id").alias("num_customers"),
            F.sum("tracks_sold").alias("tracks_sold"),
            *sum_revenue(),
            F.count_if("is_first").alias("first_time_customers"),
        )
        .select(
            "month",
            "num_purchases",
            "num_customers",
            "tracks_sold",
            revenue().cast("double").alias("revenue"),
            "first_time_customers",
        )
    )


def revenue_per_customer(df: DataFrame) -> DataFrame:
    """Add revenue per customer to a monthly or geographic result."""
    return df.withColumn("rev_per_cust", ratio("revenue", "num_customers"))
