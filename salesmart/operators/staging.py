"""Staging: the invoices a filter selects.

An invoice qualifies when one of its lines matches; afterwards all its lines count.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import DateRange, within
from salesmart.functions.key_filter import key_filter, told_bytes, words_for
from salesmart.functions.money import sum_amounts
from salesmart.operators.filters import SalesFilter
from salesmart.sources.model import SalesModel


#: Session setting: bytes of line files from which on lines are filtered where they are read.
#: Below, summing and shuffling all of them takes less than making the filter.
LEAST_BYTES = ("salesmart.lineFilter.leastBytes", 128 << 20)


def lines_of(model: SalesModel, invoices: DataFrame) -> SalesModel:
    """The model with the lines that may be on some invoices; hardly any others.

    Where few invoices are selected, most lines so end where they are read instead of being
    summed and shuffled first. What stays must still be joined with the invoices.
    """
    name, least = LEAST_BYTES
    size = told_bytes(model.line)
    if size is not None and size < int(model.line.sparkSession.conf.get(name, str(least))):
        return model
    selected = key_filter(invoices, "invoice_id", words_for(model.invoice))
    return replace(model, line=model.line.where(selected.may_hold("invoice_id")))


def candidates(model: SalesModel, flt: SalesFilter) -> tuple[DataFrame, SalesModel]:
    """The invoices that dates and countries leave, and the model with their lines."""
    invoices = flt.invoices(model)
    return invoices, lines_of(model, invoices) if flt.countries or flt.dates else model


def staged_invoices(model: SalesModel, flt: SalesFilter) -> DataFrame:
    """Qualifying invoices without measures: one row per invoice.

    Only keys of matching lines travel, one per invoice and map task, because they are
    made distinct before the semi join.
    """
    invoices, model = candidates(model, flt)
    if model.labelled:
        hits = model.line.where(flt.item_predicate())
    else:
        hits = model.line.join(model.item.where(flt.item_predicate()).select("track_id"), "track_id", "left_semi")
    keys = hits.select("invoice_id").distinct()
    return invoices.join(keys, "invoice_id", "left_semi")


def staged_sales(model: SalesModel, flt: SalesFilter) -> DataFrame:
    """Qualifying invoices with their line totals, from one pass over the lines.

    Adds ``num_lines``, ``tracks_sold`` and the two parts of the revenue. Lines are summed per invoice
    before they meet the invoices, so an invoice with very many lines costs no more
    than any other.
    """
    invoices, model = candidates(model, flt)
    if model.labelled:
        lines = model.line.withColumn("hit", F.when(flt.item_predicate(), 1))
    else:
        lines = model.line.join(model.item.where(flt.item_predicate()).select("track_id", F.lit(1).alias("hit")), "track_id", "left")
    totals = (
        lines.groupBy("invoice_id")
        .agg(
            F.count("hit").alias("hits"),
            model.line_count.alias("num_lines"),
            F.sum("quantity").alias("tracks_sold"),
            *sum_amounts("amount"),
        )
        .where("hits > 0")
        .drop("hits")
    )
    return invoices.join(totals, "invoice_id")


def filtered_invoices(staged: DataFrame) -> DataFrame:
    """The staged set itself: customer, day, invoice."""
    return staged.select("customer_id", "dt", "invoice_id").orderBy("customer_id", "dt", "invoice_id")


def invoice_details(staged: DataFrame, model: SalesModel, rng: DateRange | None) -> DataFrame:
    """Header listing of the staged invoices, range widened to whole months."""
    window = rng.month_aligned() if rng else None
    return model.with_country(staged.where(within(window, "dt"))).select(
        "invoice_id", "customer_id", "invoice_date", "country", "total"
    )


def first_purchases(invoice: DataFrame) -> DataFrame:
    """First purchase day of every customer, over all invoices."""
    return invoice.groupBy("customer_id").agg(F.min("dt").alias("first_date"))


def sold_tracks(model: SalesModel, invoices: DataFrame, *keys: str, labels: tuple[str, ...] = ()) -> DataFrame:
    """Distinct tracks on the given invoices, per extra invoice column in ``keys``.

    An invoice may hold a large share of the lines: made distinct first, it leaves no more
    than one row per track of the catalog to the join. ``labels`` are columns of the item,
    where lines carry them.
    """
    return (
        model.line.select("invoice_id", "track_id", *labels)
        .distinct()
        .join(invoices.select("invoice_id", *keys), "invoice_id")
        .select("track_id", *keys, *labels)
        .distinct()
    )


def group_sales(model: SalesModel, invoices: DataFrame, by: str) -> DataFrame:
    """Line totals per invoice and genre or artist, with the invoice's own columns.

    Lines whose item lacks the group drop out. Summing per invoice and group first
    collapses heavy invoices map-side, before the join on the invoice.
    """
    if model.labelled:
        lines = model.line.where(F.col(by).isNotNull()).withColumn("group_val", F.col(by))
    else:
        lines = model.line.join(model.item.where(F.col(by).isNotNull()).select("track_id", F.col(by).alias("group_val")), "track_id")
    totals = lines.groupBy("invoice_id", "group_val").agg(F.sum("quantity").alias("tracks_sold"), *sum_amounts("amount"))
    own = [c for c in ("invoice_id", "customer_id", "dt", "country") if c in invoices.columns]
    return totals.join(invoices.select(*own), "invoice_id")
