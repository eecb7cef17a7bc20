"""Dataset summary and the values filters can take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.display import dollar, number
from salesmart.functions.rows import first_per, fold_rows, record, unpivot
from salesmart.sources.model import SalesModel


def static_summary(model: SalesModel) -> DataFrame:
    """Eight labelled display values over the whole dataset, as ``Metric, Value``.

    Here revenue is the sum of invoice totals, tracks sold counts lines, and genres and
    artists count catalog entries, sold or not.
    """
    # Down to customer and country, then to country: every figure adds up on the way.
    spend = model.invoice.groupBy(*model.customer_keys).agg(
        F.min("dt").alias("first_date"),
        F.max("dt").alias("last_date"),
        F.sum("total").alias("revenue"),
        F.count("invoice_id").alias("purchases"),
    )
    per_country = (
        model.with_country(spend).withColumn("counts", first_per(["customer_id"], "country"))
        .groupBy("country")
        .agg(
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
            F.sum("revenue").alias("revenue"),
            F.sum("purchases").alias("purchases"),
            F.count_if("counts").alias("customers"),
        )
    )
    facts = per_country.agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.round(F.sum("revenue"), 2).cast("double").alias("revenue"),
        F.sum("purchases").alias("purchases"),
        F.sum("customers").alias("customers"),
        F.count("country").alias("countries"),
    )
    row = fold_rows(
        facts,
        model.line.agg(F.coalesce(model.line_count, F.lit(0)).alias("lines")),
        _count(model.genre, "genres"),
        _count(model.artist, "artists"),
    )
    span = F.concat(
        F.date_format("first_date", "MMM yyyy"), F.lit(" – "), F.date_format("last_date", "MMM yyyy")
    )
    # The labels, in display order.
    values = {
        "Date Range": span,
        "Number of Purchases": number("purchases"),
        "Number of Customers": number("customers"),
        "Tracks Sold": number("lines"),
        "Total Revenue (USD$)": dollar("revenue"),
        "Number of Genres": number("genres"),
        "Number of Artists": number("artists"),
        "Number of Countries": number("countries"),
    }
    return unpivot(row, [record(Metric=label, Value=text) for label, text in values.items()])


def filter_values(model: SalesModel) -> DataFrame:
    """Sorted choices of each filter, as ``kind, value``."""
    # Down to customers first: one of them may have a large share of the invoices.
    homes = model.with_country(model.invoice.select(*model.customer_keys).distinct())
    choices = [
        ("country", homes.select(F.col("country").alias("value"))),
        ("genre", model.genre.select(F.col("name").alias("value"))),
        ("artist", model.artist.select(F.col("name").alias("value"))),
    ]
    parts = [df.distinct().select(F.lit(kind).alias("kind"), "value") for kind, df in choices]
    return parts[0].union(parts[1]).union(parts[2]).orderBy("kind", F.asc_nulls_last("value"))


def date_bounds(model: SalesModel) -> DataFrame:
    """First and last invoice day."""
    return model.invoice.agg(F.min("dt").alias("min_date"), F.max("dt").alias("max_date"))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
