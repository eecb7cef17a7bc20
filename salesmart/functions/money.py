"""Exact sums of money in integer arithmetic.

A line amount is a whole number of ten-thousandths. One long could overflow over a very
large or very skewed dataset, and decimal sums cost about as much again as the whole
scan and aggregation; so the millions and the rest are summed as two longs, and only
the final figure is put together. The rest, below a million per line, stays in range
for nine trillion lines, the millions for far longer.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ten-thousandths per currency unit, and where a sum is split.
UNITS = 10_000
SPLIT = 1_000_000

HIGH, LOW = "revenue_high", "revenue_low"


def units_of_double(amount: Column) -> Column:
    """Ten-thousandths of a double amount, to the nearest."""
    return F.rint(amount * UNITS).cast("long")


def units_of_decimal(amount: Column) -> Column:
    """Ten-thousandths of a decimal amount with at most four decimals."""
    return (amount * UNITS).cast("long")


def sum_amounts(amount: str) -> list[Column]:
    """The two partial sums over line amounts."""
    rest = F.col(amount) % SPLIT
    millions = F.call_function("div", F.col(amount), F.lit(SPLIT))
    return [F.sum(millions).alias(HIGH), F.sum(rest).alias(LOW)]


def sum_revenue(where: Column | None = None) -> list[Column]:
    """The two partial sums over partial sums, of rows that satisfy ``where``."""
    return [
        F.sum(c if where is None else F.when(where, F.col(c))).alias(c) for c in (HIGH, LOW)
    ]


def revenue() -> Column:
    """The exact sum as a decimal, from its two parts."""
    whole = F.col(HIGH).cast("decimal(20,0)") * SPLIT + F.col(LOW)
    return whole * F.lit(Decimal(1) / UNITS)
