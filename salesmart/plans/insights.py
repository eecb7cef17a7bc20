"""Insight cards: all data beside a filtered view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import DateRange
from salesmart.functions.rows import rename_values
from salesmart.plans.bundle import kpi_bundle, topn_all
from salesmart.plans.mart import SalesMart

# Cards, their labels, and the KPI behind each label.
CARDS = {
    "revenue": {"revenue_total": "Total Revenue"},
    "purchases": {
        "purchases_num": "Total Orders",
        "revenue_per_purchase": "Avg Revenue per Order",
        "tracks_sold_num": "Total Tracks Sold",
        "tracks_per_purchase": "Avg Tracks per Order",
    },
    "customers": {
        "cust_num": "Total Customers",
        "cust_per_new": "% New Customers",
        "revenue_per_cust": "Avg Revenue per Customer",
        "top_cohort_line_3": "Top 3-Month Retention",
        "top_cohort_line_6": "Top 6-Month Retention",
    },
}
RANKED = {"topn_country": ("Top Markets", 3), "topn_genre": ("Top Genre", 1), "topn_artist": ("Top Artist", 1)}
SCOPES = ("All Data", "Filtered View")


def insights(
    mart: SalesMart, rng: DateRange | None, scope: str, countries: DataFrame | None = None
) -> DataFrame:
    """Card entries of one mart as ``scope, card, label, rank, name, value_fmt``."""
    labels = {kpi: label for card in CARDS.values() for kpi, label in card.items()}
    homes = {kpi: card for card, kpis in CARDS.items() for kpi in kpis}
    single = kpi_bundle(mart, rng).where(F.col("kpi").isin(*labels)).select(
        rename_values("kpi", homes).alias("card"),
        rename_values("kpi", labels).alias("label"),
        F.lit(1).alias("rank"),
        F.lit(None).cast("string").alias("name"),
        "value_fmt",
    )
    titles = {section: title for section, (title, _) in RANKED.items()}
    depth = max(places for _, places in RANKED.values())
    ranked = topn_all(mart, rng, depth, ["revenue"], countries).where(_within_places()).select(
        F.lit("revenue").alias("card"),
        rename_values("section", titles).alias("label"),
        "rank",
        F.col("group_val_fmt").alias("name"),
        F.col("revenue_fmt").alias("value_fmt"),
    )
    return single.unionByName(ranked).select(F.lit(scope).alias("scope"), "*")


def insights_compare(
    everything: SalesMart,
    full: DateRange | None,
    view: SalesMart,
    rng: DateRange | None,
    countries: DataFrame | None = None,
) -> DataFrame:
    """The cards of the whole dataset and of a filtered view, told apart by ``scope``."""
    return insights(everything, full, SCOPES[0], countries).unionByName(
        insights(view, rng, SCOPES[1], countries)
    )


def _within_places():
    allowed = F.lit(False)
    for section, (_, places) in RANKED.items():
        allowed = allowed | ((F.col("section") == section) & (F.col("rank") <= places))
    return allowed
