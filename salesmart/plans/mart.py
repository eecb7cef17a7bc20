"""A filter applied to a model, and every result that can be asked of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import DataRange, DateRange
from salesmart.functions.fingerprint import key_fingerprint
from salesmart.functions.id_tree import tree_digest
from salesmart.operators import cohorts, core, geo, groups, retention, series, staging
from salesmart.operators.filters import SalesFilter
from salesmart.operators.metrics import METRICS
from salesmart.plans.store import MONTH, StagedSets
from salesmart.sources.model import SalesModel


class SalesMart:
    """Lazy results over the invoices a filter selects.

    Results over a date range take that of the data where none is given.

    Without storing, each result plans its own staging, reading only the columns it
    needs. When several results share a filter, call :meth:`persist` (cached, rebuilt
    from the tables if executors are lost) or :meth:`checkpoint` (written to the
    cluster's checkpoint folder) first.
    """

    def __init__(
        self, model: SalesModel, flt: SalesFilter | None = None, stored: DataFrame | None = None
    ) -> None:
        self.model = model
        self.filter = flt or SalesFilter()
        self._stored = stored

    def with_filter(self, flt: SalesFilter) -> SalesMart:
        """A mart for another filter; the same filter keeps this one and its storage."""
        return self if flt == self.filter else SalesMart(self.model, flt)

    # Staging ---------------------------------------------------------------------

    @property
    def sales(self) -> DataFrame:
        """Staged invoices with their line totals."""
        if self._stored is not None:
            return self._stored
        return staging.staged_sales(self.model, self.filter)

    @property
    def invoices(self) -> DataFrame:
        """Staged invoices; line totals only if stored."""
        if self._stored is not None:
            return self._stored
        return staging.staged_invoices(self.model, self.filter)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> SalesMart:
        """Cache the staged set on first use."""
        return SalesMart(self.model, self.filter, self.sales.persist(level))

    def unpersist(self) -> SalesMart:
        """Drop the cache; further results stage anew."""
        if self._stored is not None:
            self._stored.unpersist()
        return SalesMart(self.model, self.filter)

    def checkpoint(self) -> SalesMart:
        """Write the staged set to the session's checkpoint folder and read it from there.

        Runs a job. The folder is the session's ``spark.checkpoint.dir``.
        """
        return SalesMart(self.model, self.filter, self.sales.checkpoint())

    def stored_in(self, folder: str) -> SalesMart:
        """Take the staged set from a folder that sessions share, or stage it into there.

        It is found again as long as the filter is the same and no file of the tables has
        changed; then no line is read. Results over a range read its months only. May run
        a job.
        """
        return SalesMart(self.model, self.filter, StagedSets(folder).staged(self.model, self.filter))

    def register(self, view: str = "filtered_invoices") -> None:
        """Create or replace temporary views of the staged set and both catalogs."""
        self.invoices.select("customer_id", "dt", "invoice_id").createOrReplaceTempView(view)
        self.catalog("genre").createOrReplaceTempView("genre_catalog")
        self.catalog("artist").createOrReplaceTempView("artist_catalog")

    def is_registered(self, view: str = "filtered_invoices") -> bool:
        """True when the views made by :meth:`register` all exist."""
        tables = self.model.invoice.sparkSession.catalog
        return all(tables.tableExists(v) for v in (view, "genre_catalog", "artist_catalog"))

    def filtered_invoices(self) -> DataFrame:
        return staging.filtered_invoices(self.invoices)

    def invoice_details(self, rng: DateRange | None = None) -> DataFrame:
        return staging.invoice_details(self._in_months(self.invoices, rng), self.model, rng)

    def fingerprint(self) -> DataFrame:
        """Identity of the staged invoice set."""
        return key_fingerprint(self.invoices, "invoice_id")

    def _in_months(self, staged: DataFrame, rng: DateRange | None) -> DataFrame:
        """Of a set partitioned by month, the partitions of a range; others as they are."""
        if rng is None or MONTH not in staged.columns:
            return staged
        whole = rng.month_aligned()
        return staged.where(F.col(MONTH).between(F.lit(whole.start), F.lit(whole.end)))

    def _sold(self, rng: DateRange | None) -> SalesModel:
        """The model, with the lines of the staged invoices of a range where not all are."""
        if rng is None and self.filter == SalesFilter():
            return self.model
        chosen = self.invoices if rng is None else self._in_months(self.invoices, rng).where(rng.month_aligned().contains("dt"))
        return staging.lines_of(self.model, chosen)

    def digest(self) -> DataFrame:
        """Exact identity of the staged invoice set, as the root of a tree over its ids."""
        return tree_digest(self.invoices, "invoice_id")

    def _range(self, rng: DateRange | None) -> DateRange | DataRange:
        return DataRange.of(self.model.invoice) if rng is None else rng

    # KPIs ------------------------------------------------------------------------

    def core_kpis(self, rng: DateRange | None = None) -> DataFrame:
        return core.core_kpis(self._in_months(self.sales, rng), self._sold(rng), self._range(rng))

    def total_revenue(self, rng: DateRange | None = None) -> Column:
        """Revenue of the range as a scalar subquery, for use in expressions."""
        return core.total_revenue(self._in_months(self.sales, rng), rng).scalar()

    def group_kpis(self, by: str, rng: DateRange | None = None) -> DataFrame:
        return self._group_kpis(by, rng).orderBy("group_val")

    def _group_kpis(self, by: str, rng: DateRange | None) -> DataFrame:
        staged = self._in_months(self.sales if by == "country" else self.invoices, rng)
        model = self.model if by == "country" else self._sold(rng)
        return groups.group_kpis(staged, model, by, rng)

    def catalog(self, by: str) -> DataFrame:
        return groups.catalog(self.model, by)

    def catalog_sales(self, by: str, rng: DateRange | None = None) -> DataFrame:
        return groups.catalog_sales(self._in_months(self.invoices, rng), self._sold(rng), by, rng).orderBy("group_val")

    def top_n(
        self,
        by: str,
        rng: DateRange | None = None,
        n: int = 5,
        metrics: Sequence[str] = tuple(METRICS),
        total: Column | None = None,
    ) -> DataFrame:
        """Top groups per metric with averages, share of revenue and catalog coverage.

        ``total`` saves working out the revenue of the range again; see
        :meth:`total_revenue`.
        """
        best = groups.top_n(self._group_kpis(by, rng), n, metrics)
        total = self.total_revenue(rng) if total is None else total
        coverage = None
        if by in groups.CATALOGED:
            coverage = groups.catalog_sales(self._in_months(self.invoices, rng), self._sold(rng), by, rng)
        return groups.enrich_top_n(best, total, coverage)

    def group_yearly(self, by: str, rng: DateRange | None = None) -> DataFrame:
        return self._group_yearly(by, rng).orderBy("year", by)

    def _group_yearly(self, by: str, rng: DateRange | None) -> DataFrame:
        return groups.group_yearly(self._in_months(self.invoices, rng), self._sold(rng), by, self._range(rng))

    def top_groups_yearly(
        self, by: str, rng: DateRange | None = None, metric: str = "revenue", n: int = 20
    ) -> DataFrame:
        return groups.top_groups_yearly(self._group_yearly(by, rng), by, metric, n)

    # Series and geography ----------------------------------------------------------

    def monthly_summary(self, rng: DateRange | None = None) -> DataFrame:
        return series.monthly_summary(self.sales, self._range(rng)).orderBy("month")

    def geo_metrics(self, rng: DateRange | None = None, mode: str = "yearly") -> DataFrame:
        """``All`` sorts after the digits of any year."""
        metrics = geo.geo_metrics(self.sales, self.model, self._range(rng), mode)
        return metrics.orderBy("year", F.asc_nulls_last("country"))

    # Retention -----------------------------------------------------------------------

    def cohort_retention(self, rng: DateRange | None = None, max_offset: int | None = None) -> DataFrame:
        return self._cohorts(rng, max_offset).orderBy("cohort_month", "month_offset")

    def _cohorts(self, rng: DateRange | None, max_offset: int | None) -> DataFrame:
        return cohorts.cohort_retention(self.invoices, self.model, self._range(rng), max_offset)

    def top_cohorts(
        self, rng: DateRange | None = None, offsets: Sequence[int] = (3, 6, 9), max_offset: int | None = None
    ) -> DataFrame:
        return cohorts.top_cohorts(self._cohorts(rng, max_offset), offsets)

    def cohort_grid(self, rng: DateRange | None = None, max_offset: int | None = None) -> DataFrame:
        return cohorts.cohort_grid(self._cohorts(rng, max_offset))

    def retention_decay(self, rng: DateRange | None = None, max_offset: int | None = None) -> DataFrame:
        decay = cohorts.retention_decay(self.invoices, self.model, self._range(rng), max_offset)
        return decay.orderBy("month_offset")

    def customer_bounds(self, rng: DateRange | None = None) -> DataFrame:
        return retention.customer_bounds(self.invoices, rng)

    def customer_metrics(self, rng: DateRange | None = None, strict: bool = False) -> DataFrame:
        return retention.customer_metrics(self.customer_bounds(rng), rng, strict)

    def retention_kpis(
        self, rng: DateRange | None = None, strict: bool = False, rank_error: float | None = None
    ) -> DataFrame:
        """Medians are exact unless a rank error, a share of the rows, is allowed."""
        return retention.retention_kpis(self.customer_metrics(rng, strict), rank_error)
