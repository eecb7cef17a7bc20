"""Customer purchase boundaries, gaps and lifespans, and the retention KPIs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.functions.dates import DateRange, months_apart, within
from salesmart.functions.display import MISSING, display
from salesmart.functions.ratios import ratio

# KPI names in order, with how each is displayed.
RETENTION_KPIS = {
    "num_cust": "number",
    "num_new": "number",
    "pct_new": "percent",
    "ret_n_any": "number",
    "ret_rate_any": "percent",
    "ret_n_return": "number",
    "ret_rate_return": "percent",
    "ret_n_conv": "number",
    "ret_rate_conv": "percent",
    "ret_n_window": "number",
    "ret_rate_window": "percent",
    "avg_life_mo_tot": "float",
    "avg_life_mo_win": "float",
    "med_gap_life": "float",
    "med_gap_window": "float",
    "med_gap_winback": "float",
    "med_gap_ret": "float",
    "avg_gap_life": "float",
    "avg_gap_window": "float",
    "avg_gap_bound": "float",
}

# One-line texts, each a count and its rate.
RETENTION_LINES = {
    "cust_line": ("num_cust", "pct_new"),
    "ret_any_line": ("ret_n_any", "ret_rate_any"),
    "ret_return_line": ("ret_n_return", "ret_rate_return"),
    "ret_conv_line": ("ret_n_conv", "ret_rate_conv"),
    "ret_window_line": ("ret_n_window", "ret_rate_window"),
}


def daily_purchases(staged: DataFrame) -> DataFrame:
    """Purchases of every customer and day, which the calendar bounds per customer."""
    return staged.groupBy("customer_id", "dt").agg(F.count(F.lit(1)).alias("n"))


def customer_bounds(staged: DataFrame, rng: DateRange | None) -> DataFrame:
    """Purchase boundaries of every customer with a purchase in the window."""
    return bounds_of_days(daily_purchases(staged), rng)


def bounds_of_days(daily: DataFrame, rng: DateRange | None) -> DataFrame:
    """The boundaries from purchases per customer and day.

    Even a customer holding a third of all invoices leaves few rows to order. The
    second purchase is on the first day if that day has two, else on the next day.
    """
    inside = within(rng, "dt")
    by_day = Window.partitionBy("customer_id").orderBy("dt")
    following = (
        daily.withColumn("next_dt", F.lead("dt").over(by_day))
        .withColumn("second", F.when(F.col("n") > 1, F.col("dt")).otherwise(F.col("next_dt")))
        .withColumn("in_window", inside)
    )
    day_inside = F.when(F.col("in_window"), F.col("dt"))
    second_inside = F.when(within(rng, "second"), F.col("second"))
    before = F.lit(None).cast("date") if rng is None else F.when(rng.lies_after("dt"), F.col("dt"))
    after = F.lit(None).cast("date") if rng is None else F.when(rng.lies_before("dt"), F.col("dt"))
    return (
        following.groupBy("customer_id")
        .agg(
            F.min("dt").alias("first_date"),
            F.min_by("second", "dt").alias("second_date"),
            F.max("dt").alias("last_date"),
            F.sum("n").alias("total_purchases"),
            F.max(before).alias("last_before_window"),
            F.min(after).alias("first_after_window"),
            F.sum(F.when(F.col("in_window"), F.col("n"))).alias("num_in_window"),
            F.min(day_inside).alias("first_in_window"),
            F.min_by(second_inside, day_inside).alias("second_in_window"),
            F.max(day_inside).alias("last_in_window"),
        )
        .where("num_in_window > 0")
    )


def customer_metrics(bounds: DataFrame, rng: DateRange | None, strict: bool = False) -> DataFrame:
    """Flags, lifespans in months and gaps in days per customer.

    A new customer counts as converted with two purchases in the window or *none after
    it*: kept as defined by the results to match. ``strict`` asks for a purchase after
    the window instead.
    """
    has_before = F.col("last_before_window").isNotNull()
    has_after = F.col("first_after_window").isNotNull()
    many = F.col("total_purchases") > 1
    many_inside = F.col("num_in_window") > 1
    later = has_after if strict else ~has_after
    avg_inside = _mean_gap("first_in_window", "last_in_window", F.col("num_in_window") - 1)
    return bounds.withColumns(
        {
            "cust_new": ~has_before,
            "repeat_any": many,
            "repeat_ret": has_before,
            "repeat_conv": ~has_before & (many_inside | later),
            "repeat_window": many_inside,
            "lifespan_mo_total": F.when(many, months_apart("first_date", "last_date")),
            "lifespan_mo_window": _window_lifespan(rng, has_before, has_after, many_inside),
            "gap_life": F.datediff("second_date", "first_date"),
            "gap_window": F.datediff("second_in_window", "first_in_window"),
            "gap_winback": F.datediff("first_in_window", "last_before_window"),
            "gap_retention": F.datediff("first_after_window", "last_in_window"),
            "avg_gap_life": _mean_gap("first_date", "last_date", F.col("total_purchases") - 1),
            "avg_gap_window": avg_inside,
            "avg_gap_bound": (
                F.when(
                    has_before & has_after,
                    _mean_gap("last_before_window", "first_after_window", F.col("num_in_window") + 1),
                )
                .when(has_before, _mean_gap("last_before_window", "last_in_window", F.col("num_in_window")))
                .when(has_after, _mean_gap("first_in_window", "first_after_window", F.col("num_in_window")))
                .otherwise(avg_inside)
            ),
        }
    )


def median(column: str, rank_error: float | None) -> Column:
    """The exact median, or a value whose rank is off by this share of the rows at most."""
    if rank_error is None:
        return F.median(column)
    if not 0 < rank_error < 1:
        raise ValueError("the rank error is a share between 0 and 1")
    return F.percentile_approx(column, 0.5, math.ceil(1 / rank_error)).cast("double")


def retention_kpis(metrics: DataFrame, rank_error: float | None = None) -> DataFrame:
    """One row of retention KPIs; no row when no customer bought in the window.

    Medians are exact unless a rank error is allowed. The state of exact ones is one counter
    per distinct gap in days, which the calendar bounds, and it merges across tasks; that of
    others is a sketch whose size the error bounds.
    """
    counts = metrics.agg(
        F.count(F.lit(1)).alias("num_cust"),
        F.count_if("cust_new").alias("num_new"),
        F.count_if("repeat_any").alias("ret_n_any"),
        F.count_if("repeat_ret").alias("ret_n_return"),
        F.count_if("repeat_conv").alias("ret_n_conv"),
        F.count_if("repeat_window").alias("ret_n_window"),
        F.avg("lifespan_mo_total").alias("avg_life_mo_tot"),
        F.avg("lifespan_mo_window").alias("avg_life_mo_win"),
        median("gap_life", rank_error).alias("med_gap_life"),
        median("gap_window", rank_error).alias("med_gap_window"),
        median("gap_winback", rank_error).alias("med_gap_winback"),
        median("gap_retention", rank_error).alias("med_gap_ret"),
        F.avg("avg_gap_life").alias("avg_gap_life"),
        F.avg("avg_gap_window").alias("avg_gap_window"),
        F.avg("avg_gap_bound").alias("avg_gap_bound"),
    )
    rates = {
        "pct_new": ratio("num_new", "num_cust"),
        "ret_rate_any": ratio("ret_n_any", "num_cust"),
        "ret_rate_return": ratio(F.col("ret_n_return"), F.col("num_cust") - F.col("num_new")),
        "ret_rate_conv": ratio("ret_n_conv", "num_new"),
        "ret_rate_window": ratio("ret_n_window", "num_cust"),
    }
    return counts.where("num_cust > 0").withColumns(rates).select(*RETENTION_KPIS)


def retention_lines(kpis: DataFrame) -> DataFrame:
    """The count-and-rate lines of a retention KPI row, as text columns."""
    return kpis.select(
        *[
            F.format_string(
                "%s (%s)", display(count, RETENTION_KPIS[count]), display(rate, RETENTION_KPIS[rate])
            ).alias(name)
            for name, (count, rate) in RETENTION_LINES.items()
        ]
    )


def display_top_cohorts(best: DataFrame) -> DataFrame:
    """Month, rate and one-line texts of the best cohorts."""
    month = F.coalesce(F.date_format("cohort_month", "MMM yyyy"), F.lit(MISSING))
    rate = display("retention_pct", "percent")
    return best.select(
        "month_offset",
        month.alias("top_cohort_month"),
        rate.alias("top_cohort_retention"),
        F.format_string("%s (%s)", month, rate).alias("top_cohort_line"),
    )


def _mean_gap(first: str, last: str, steps: Column) -> Column:
    """Days between two purchases spread over the steps between them; null without steps."""
    return ratio(F.datediff(last, first), F.when(steps > 0, steps))


def _window_lifespan(
    rng: DateRange | None, has_before: Column, has_after: Column, many_inside: Column
) -> Column:
    """Months active inside the window; its edge stands in where purchases lie beyond it."""
    seen = F.when(many_inside, months_apart("first_in_window", "last_in_window"))
    if rng is None:
        return seen
    start, end = F.lit(rng.start), F.lit(rng.end)
    return (
        F.when(has_before & has_after, months_apart(start, end))
        .when(has_before, months_apart(start, "last_in_window"))
        .when(has_after, months_apart("first_in_window", end))
        .otherwise(seen)
    )
