"""Every result as a named query over a directory of wholesale tables.

Each result is registered over all dates of the data without a filter; results that read
a window or a filter differently are registered again as ``*_window`` (dates that start
and end inside a month) and ``*_filtered``. Means of fractions depend on the order of
summation in their last digits; they are rounded here, for comparison only.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.dates import DateRange
from salesmart.functions.fingerprint import frame_fingerprint
from salesmart.operators import cohorts, geo, groups, series, summary
from salesmart.operators.filters import SalesFilter
from salesmart.plans.bundle import kpi_bundle, topn_all
from salesmart.plans.customers import CustomerDays
from salesmart.plans.distinct import DistinctSets
from salesmart.plans.insights import insights_compare
from salesmart.plans.mart import SalesMart
from salesmart.session import configure
from salesmart.sources.layout import read_layout, write_layout
from salesmart.sources.model import SalesModel
from salesmart.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

WINDOW = DateRange.of("1997-03-10", "1998-11-20")
YEARS = DateRange.of("1997-01-01", "1998-12-31")
CHOICE = SalesFilter(genres=("ECONOMY",), countries=("NATION_2", "NATION_3"))


@dataclass(frozen=True)
class Variant:
    suffix: str
    filter: SalesFilter
    rng: DateRange | None


PLAIN = Variant("", SalesFilter(), None)
WINDOWED = Variant("_window", SalesFilter(), WINDOW)
FILTERED = Variant("_filtered", CHOICE, YEARS)
VARIANTS = (PLAIN, WINDOWED, FILTERED)
NOTHING = SalesFilter(genres=("NO SUCH GENRE",))


def country_codes(spark: SparkSession, directory: str) -> DataFrame:
    """Country dimension of the wholesale data: codes made from region and nation keys."""
    nation = spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(
        f"{directory.rstrip('/')}/nation.parquet"
    )
    letter = lambda key: F.chr(F.pmod(F.col(key), F.lit(26)) + 65)
    # Without a letter of its own a nation has no code, and so no flag.
    iso2 = F.when(F.col("n_nationkey").between(0, 25), F.concat(letter("n_regionkey"), letter("n_nationkey")))
    return nation.select(
        F.col("n_name").alias("country"),
        iso2.alias("iso2"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"),
        F.col("n_name").alias("label"),
    )


# Means of fractions, and the digits kept of them.
MEANS = ("avg_gap_life", "avg_gap_window", "avg_gap_bound")
DIGITS = 6


def released(result: DataFrame, *marts: SalesMart) -> DataFrame:
    """The result; when it is let go, so are the staged sets it shares."""
    for mart in marts:
        weakref.finalize(result, mart.unpersist).atexit = False
    return result


def _bundle(mart: SalesMart, v: Variant) -> DataFrame:
    short = F.when(F.col("kpi").isin(*MEANS), F.round("value", DIGITS)).otherwise(F.col("value"))
    kept = mart.persist()
    return released(kpi_bundle(kept, v.rng).withColumn("value", short), kept)


def _bundle_fingerprint(mart: SalesMart, v: Variant) -> DataFrame:
    kept = mart.persist()
    return released(frame_fingerprint(kpi_bundle(kept, v.rng).select("section", "kpi", "value_fmt")), kept)


def _top_n(mart: SalesMart, v: Variant, by: str) -> DataFrame:
    kept = mart.persist()
    return released(kept.top_n(by, v.rng), kept)


def _cohorts(mart: SalesMart, v: Variant) -> DataFrame:
    return mart.cohort_retention(v.rng)


def _matrix(mart: SalesMart, v: Variant) -> DataFrame:
    """The arrays of the matrix as text, so that engines with other lists can be compared."""
    shown = F.transform("retention_pct", lambda p: F.coalesce(F.format_number(p, 2), F.lit("-")))
    return cohorts.cohort_matrix(mart.cohort_grid(v.rng)).select(
        "cohort_month",
        "cohort_label",
        F.array_join(F.col("offsets").cast("array<string>"), " ").alias("offsets"),
        F.array_join(shown, " ").alias("retention_pct"),
    )


def _strict(mart: SalesMart, v: Variant) -> DataFrame:
    rounded = {c: F.round(c, DIGITS) for c in MEANS}
    return mart.retention_kpis(v.rng, strict=True).withColumns(rounded)


def _yearly(mart: SalesMart, v: Variant, by: str) -> DataFrame:
    return groups.yearly_ratios(mart.group_yearly(by, v.rng))


# Results that depend on a filter and a date range.
SCOPED: dict[str, Callable[[SalesMart, Variant], DataFrame]] = {
    "filtered_invoices": lambda m, v: m.filtered_invoices(),
    "invoice_details": lambda m, v: m.invoice_details(v.rng).withColumn("total", F.col("total").cast("double")),
    "core_kpis": lambda m, v: m.core_kpis(v.rng),
    "group_kpis_genre": lambda m, v: m.group_kpis("genre", v.rng),
    "group_kpis_artist": lambda m, v: m.group_kpis("artist", v.rng),
    "group_kpis_country": lambda m, v: m.group_kpis("country", v.rng),
    "topn_genre": partial(_top_n, by="genre"),
    "topn_artist": partial(_top_n, by="artist"),
    "topn_country": partial(_top_n, by="country"),
    "catalog_sales_genre": lambda m, v: m.catalog_sales("genre", v.rng),
    "catalog_sales_artist": lambda m, v: m.catalog_sales("artist", v.rng),
    "monthly_summary": lambda m, v: series.revenue_per_customer(m.monthly_summary(v.rng)),
    "geo_yearly": lambda m, v: m.geo_metrics(v.rng, "yearly"),
    "geo_aggregate": lambda m, v: series.revenue_per_customer(m.geo_metrics(v.rng, "aggregate")),
    "geo_frames": lambda m, v: m.geo_metrics(v.rng, "frames"),
    "geo_metric_bounds": lambda m, v: geo.metric_bounds(m.geo_metrics(v.rng, "frames")),
    "group_yearly_genre": partial(_yearly, by="genre"),
    "group_yearly_artist": partial(_yearly, by="artist"),
    "top_groups_yearly": lambda m, v: m.top_groups_yearly("artist", v.rng),
    "top_groups_yearly_genre": lambda m, v: m.top_groups_yearly("genre", v.rng),
    "top_groups_yearly_customers": lambda m, v: m.top_groups_yearly("artist", v.rng, "num_customers", 7),
    "cohort_retention": _cohorts,
    "cohort_grid": lambda m, v: m.cohort_grid(v.rng),
    "cohort_matrix": _matrix,
    "cohort_fingerprint": lambda m, v: frame_fingerprint(_cohorts(m, v)),
    "top_cohorts": lambda m, v: m.top_cohorts(v.rng),
    "retention_decay": lambda m, v: m.retention_decay(v.rng),
    "retention_decay_percent": lambda m, v: cohorts.decay_percent(m.retention_decay(v.rng)),
    "customer_bounds": lambda m, v: m.customer_bounds(v.rng),
    "customer_metrics": lambda m, v: m.customer_metrics(v.rng),
    "retention_kpis": lambda m, v: m.retention_kpis(v.rng).withColumns(
        {c: F.round(c, DIGITS) for c in MEANS}
    ),
    "retention_kpis_strict": _strict,
    "filter_fingerprint": lambda m, v: m.fingerprint(),
    "kpi_bundle_long": _bundle,
    "bundle_fingerprint": _bundle_fingerprint,
}

# Results of which a window inside months takes a branch of its own.
WINDOW_SENSITIVE = {
    "invoice_details",
    "core_kpis",
    "group_kpis_genre",
    "group_kpis_country",
    "monthly_summary",
    "geo_frames",
    "group_yearly_artist",
    "cohort_retention",
    "retention_decay",
    "top_cohorts",
    "customer_bounds",
    "customer_metrics",
    "retention_kpis",
    "retention_kpis_strict",
    "kpi_bundle_long",
}

# Results of the model alone.
UNSCOPED: dict[str, Callable[[SalesModel], DataFrame]] = {
    "genre_catalog": lambda model: groups.catalog(model, "genre"),
    "artist_catalog": lambda model: groups.catalog(model, "artist"),
    "static_summary": summary.static_summary,
    "filter_values": summary.filter_values,
    "date_bounds": summary.date_bounds,
}


# Results over tables that are written for it when the query is built: co-located by
# invoice, and staged sets that are found again.
WRITTEN = ("core_kpis", "group_kpis_genre", "group_yearly_artist", "monthly_summary", "catalog_sales_artist", "customer_bounds")


def variants_of(name: str) -> list[Variant]:
    return [v for v in VARIANTS if v is not WINDOWED or name in WINDOW_SENSITIVE]


def mart_for(spark: SparkSession, directory: str, flt: SalesFilter) -> SalesMart:
    return SalesMart(SalesModel.read_wholesale(configure(spark), directory), flt)


def build_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name, build in SCOPED.items():
        for v in variants_of(name):
            found[name + v.suffix] = partial(_scoped, build, v)
    for name, build in UNSCOPED.items():
        found[name] = partial(_unscoped, build)
    for v in (PLAIN, FILTERED):
        found["topn_all" + v.suffix] = partial(_coded, _topn_all, v)
        found["geo_iso" + v.suffix] = partial(_coded, _geo_iso, v)
    found["insights_compare"] = _insights
    found["country_codes_topn"] = partial(_coded, _code_labels, PLAIN)
    for name in ("core_kpis", "group_kpis_genre", "monthly_summary", "geo_frames", "retention_kpis"):
        found[f"{name}_empty"] = partial(_scoped, SCOPED[name], Variant("_empty", NOTHING, None))
    for name in WRITTEN:
        for v in (PLAIN, FILTERED):
            found[f"{name}{v.suffix}_colocated"] = partial(_colocated, SCOPED[name], v)
            found[f"{name}{v.suffix}_found_again"] = partial(_found_again, SCOPED[name], v)
    for v in VARIANTS:
        for by in groups.GROUPS:
            found[f"distinct_counts_{by}{v.suffix}_kept"] = partial(_distinct, by, v)
        found[f"customer_bounds{v.suffix}_in_batches"] = partial(_batched, v)
        found[f"filter_digest{v.suffix}"] = partial(_scoped, lambda m, v: m.digest(), v)
    found["static_summary_colocated"] = lambda spark, directory: summary.static_summary(colocated(spark, directory))
    return found


def colocated(spark: SparkSession, directory: str) -> SalesModel:
    """The wholesale tables, written in buckets by invoice below the shared folder."""
    folder = shared_folder(spark)
    write_layout(SalesModel.read_wholesale(configure(spark), directory), folder)
    return read_layout(spark, folder)


def _colocated(build, v: Variant, spark: SparkSession, directory: str) -> DataFrame:
    return build(SalesMart(colocated(spark, directory), v.filter), v)


def _found_again(build, v: Variant, spark: SparkSession, directory: str) -> DataFrame:
    """By a second mart, which finds the set that the first one has staged."""
    folder = shared_folder(spark)
    mart_for(spark, directory, v.filter).stored_in(folder)
    return build(mart_for(spark, directory, v.filter).stored_in(folder), v)


def _distinct(by: str, v: Variant, spark: SparkSession, directory: str) -> DataFrame:
    sets = DistinctSets(shared_folder(spark))
    sets.write(mart_for(spark, directory, v.filter))
    return sets.counts(spark, by, v.rng)


def _batched(v: Variant, spark: SparkSession, directory: str) -> DataFrame:
    """Boundaries over invoices that came in two batches."""
    days, mart = CustomerDays(shared_folder(spark)), mart_for(spark, directory, v.filter)
    for batch, own in (("early", F.col("dt") < F.lit("1997-06-01")), ("late", F.col("dt") >= F.lit("1997-06-01"))):
        days.add(batch, mart.invoices.where(own))
    return days.bounds(spark, v.rng)


def _scoped(build, v: Variant, spark: SparkSession, directory: str) -> DataFrame:
    return build(mart_for(spark, directory, v.filter), v)


def _unscoped(build, spark: SparkSession, directory: str) -> DataFrame:
    return build(SalesModel.read_wholesale(configure(spark), directory))


def _coded(build, v: Variant, spark: SparkSession, directory: str) -> DataFrame:
    return build(mart_for(spark, directory, v.filter), v, country_codes(spark, directory))


def _topn_all(mart: SalesMart, v: Variant, codes: DataFrame) -> DataFrame:
    kept = mart.persist()
    return released(topn_all(kept, v.rng, countries=codes), kept)


def _code_labels(mart: SalesMart, v: Variant, codes: DataFrame) -> DataFrame:
    """The ranking of countries with codes for labels."""
    kept = mart.persist()
    shown = groups.display_top_n(kept.top_n("country", v.rng), codes, label="iso3")
    return released(shown.select("metric", "rank", "group_val", "group_val_fmt"), kept)


def _geo_iso(mart: SalesMart, v: Variant, codes: DataFrame) -> DataFrame:
    return geo.with_iso3(mart.geo_metrics(v.rng, "frames"), codes)


def _insights(spark: SparkSession, directory: str) -> DataFrame:
    everything = mart_for(spark, directory, PLAIN.filter).persist()
    view = SalesMart(everything.model, FILTERED.filter).persist()
    cards = insights_compare(everything, PLAIN.rng, view, FILTERED.rng, country_codes(spark, directory))
    return released(cards, everything, view)
