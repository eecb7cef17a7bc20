"""The optional, conjunctive filter behind a staged set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import DateRange
from salesmart.sources.model import SalesModel


@dataclass(frozen=True)
class SalesFilter:
    """Countries, genres, artists and an optional date range; empty means no restriction.

    Staging normally carries no dates: results take their own range, so lifetime
    figures still see the whole staged history. A range given here is widened to whole
    months.
    """

    countries: Sequence[str] = ()
    genres: Sequence[str] = ()
    artists: Sequence[str] = ()
    dates: DateRange | None = None

    def invoices(self, model: SalesModel) -> DataFrame:
        """The invoices that the dates and countries leave."""
        rows = model.invoice
        if self.dates is not None:
            rows = rows.where(self.dates.month_aligned().contains("dt"))
        if not self.countries:
            return rows
        chosen = F.col("country").isin(*self.countries)
        if model.homes is None:
            return rows.where(chosen)
        return rows.join(model.homes.where(chosen).select("customer_id"), "customer_id", "left_semi")

    def item_predicate(self) -> Column:
        """A line only counts towards staging when its item has a genre and an artist."""
        tests = [F.col("genre").isNotNull(), F.col("artist").isNotNull()]
        if self.genres:
            tests.append(F.col("genre").isin(*self.genres))
        if self.artists:
            tests.append(F.col("artist").isin(*self.artists))
        return _all_of(tests)


def _all_of(tests: list[Column]) -> Column:
    whole = F.lit(True)
    for test in tests:
        whole = whole & test
    return whole
