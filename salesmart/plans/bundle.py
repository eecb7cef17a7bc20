"""The shared KPI bundle: core, top-N and retention results of one mart.

Persist or checkpoint the mart first, so that all parts read one staged set.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import DateRange
from salesmart.functions.display import display
from salesmart.functions.rows import fold_rows, record, unpivot
from salesmart.operators.core import CORE_KPIS
from salesmart.operators.groups import GROUPS, display_top_n
from salesmart.operators.metrics import METRICS
from salesmart.operators.retention import (
    RETENTION_KPIS,
    RETENTION_LINES,
    display_top_cohorts,
    retention_lines,
)
from salesmart.plans.mart import SalesMart

# Offsets of the cohort snapshots and size of the rankings.
OFFSETS = (3, 6, 9)
TOP_N = 5


def kpi_bundle(
    mart: SalesMart,
    rng: DateRange | None = None,
    offsets: Sequence[int] = OFFSETS,
    max_offset: int | None = None,
) -> DataFrame:
    """All scalar KPIs as ``section, kpi, value, value_fmt``; no rows without invoices.

    The three sources are single rows; they merge into one, which is then unpivoted.
    """
    kpis = mart.retention_kpis(rng)
    best = mart.top_cohorts(rng, offsets, max_offset)
    row = fold_rows(mart.core_kpis(rng), kpis, retention_lines(kpis), _snapshot_row(best, offsets))
    return unpivot(row.where("purchases_num > 0"), _records(offsets)).where("section IS NOT NULL")


def topn_all(
    mart: SalesMart,
    rng: DateRange | None,
    n: int = TOP_N,
    metrics: Sequence[str] = tuple(METRICS),
    countries: DataFrame | None = None,
) -> DataFrame:
    """Every ranking for genres, artists and countries in one frame, with display columns."""
    total = mart.total_revenue(rng)
    parts = [
        display_top_n(mart.top_n(by, rng, n, metrics, total), countries if by == "country" else None)
        .withColumn("section", F.lit(f"topn_{by}"))
        for by in GROUPS
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.select("section", *[c for c in stacked.columns if c != "section"]).orderBy(
        "section", "metric", "rank"
    )


def _snapshot_row(best: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Best-cohort texts of all offsets side by side in one row."""
    texts = display_top_cohorts(best).join(best.select("month_offset", "retention_pct"), "month_offset")
    columns = ("top_cohort_month", "top_cohort_retention", "top_cohort_line", "retention_pct")
    return texts.agg(
        *[
            F.max(F.when(F.col("month_offset") == o, F.col(c))).alias(f"{c}_{o}")
            for o in offsets
            for c in columns
        ]
    )


def _records(offsets: Sequence[int]) -> list:
    nothing = F.lit(None).cast("double")
    # Retention figures exist only where a customer bought in the raw range.
    held = F.when(F.col("num_cust") > 0, F.lit("retention_kpis"))
    records = [
        record(
            section="metadata_kpis",
            kpi=name,
            value=F.col(name).cast("double"),
            value_fmt=display(name, kind),
        )
        for name, kind in CORE_KPIS.items()
    ]
    records += [
        record(
            section=f"topn_{by}",
            kpi="num_vals",
            value=F.col(f"{by}_num").cast("double"),
            value_fmt=display(f"{by}_num", "number"),
        )
        for by in GROUPS
    ]
    records += [
        record(section=held, kpi=name, value=F.col(name).cast("double"), value_fmt=display(name, kind))
        for name, kind in RETENTION_KPIS.items()
    ]
    records += [
        record(section=held, kpi=name, value=nothing, value_fmt=F.col(name)) for name in RETENTION_LINES
    ]
    for o in offsets:
        rate = F.col(f"retention_pct_{o}").cast("double")
        for kpi, value in (
            ("top_cohort_month", nothing),
            ("top_cohort_retention", rate),
            ("top_cohort_line", nothing),
        ):
            records.append(
                record(section=held, kpi=f"{kpi}_{o}", value=value, value_fmt=F.col(f"{kpi}_{o}"))
            )
    return records
