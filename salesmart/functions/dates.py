"""Calendar arithmetic on DATE columns.

A given range is known when the plan is built, so its bounds become literals that the
optimizer pushes into the scan. Without one, the range is that of the data: nothing is cut,
and the bounds are scalars the plan works out where it needs them.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


@dataclass(frozen=True)
class DateRange:
    """A closed range of days, ``start`` and ``end`` included."""

    start: date
    end: date

    @classmethod
    def of(cls, start: date | str, end: date | str) -> DateRange:
        """Build a range from dates or ISO strings."""
        return cls(_to_date(start), _to_date(end))

    def month_aligned(self) -> DateRange:
        """Widen to the first day of the first month and the last day of the last."""
        last = calendar.monthrange(self.end.year, self.end.month)[1]
        return DateRange(self.start.replace(day=1), self.end.replace(day=last))

    def whole_months(self) -> DateRange | None:
        """From the first day of the first month that is inside to the last of the last one."""
        aligned = self.month_aligned()
        start = aligned.start if self.start == aligned.start else (aligned.start + timedelta(days=31)).replace(day=1)
        end = aligned.end if self.end == aligned.end else aligned.end.replace(day=1) - timedelta(days=1)
        return DateRange(start, end) if start <= end else None

    @property
    def months(self) -> int:
        """Calendar months touched, both ends included."""
        return (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1

    @property
    def full_months(self) -> int:
        """Whole months elapsed from start to end, plus one.

        A month has elapsed once the end reaches the start's day, or the end of a
        month too short to hold that day.
        """
        last = calendar.monthrange(self.end.year, self.end.month)[1]
        complete = self.end.day >= min(self.start.day, last)
        return self.months - (0 if complete else 1)

    def contains(self, col: Column | str) -> Column:
        return as_column(col).between(F.lit(self.start), F.lit(self.end))

    def lies_before(self, col: Column | str) -> Column:
        """True where the range ends before the day."""
        return F.lit(self.end) < as_column(col)

    def lies_after(self, col: Column | str) -> Column:
        """True where the range starts after the day."""
        return F.lit(self.start) > as_column(col)

    def months_of_year(self, year: Column) -> Column:
        """How many months of the integer ``year`` the range touches."""
        first = F.when(year == self.start.year, self.start.month).otherwise(1)
        last = F.when(year == self.end.year, self.end.month).otherwise(12)
        return (last - first + 1).cast("int")


@dataclass(frozen=True)
class DataRange:
    """From the first to the last day of the data, as scalars of the plan.

    Offers what operators ask of a :class:`DateRange`. Every day is inside, so nothing is
    compared, and only results that count months read the bounds.
    """

    start: Column
    end: Column

    @classmethod
    def of(cls, invoice: DataFrame) -> DataRange:
        ends = invoice.agg(F.struct(F.min("dt").alias("first"), F.max("dt").alias("last")).alias("ends")).scalar()
        return cls(ends["first"], ends["last"])

    def month_aligned(self) -> DataRange:
        """Itself: there is no further day in its first and last month."""
        return self

    @property
    def months(self) -> Column:
        return months_apart(self.start, self.end) + 1

    @property
    def full_months(self) -> Column:
        complete = F.day(self.end) >= F.least(F.day(self.start), F.day(F.last_day(self.end)))
        return self.months - F.when(complete, 0).otherwise(1)

    def contains(self, col: Column | str) -> Column:
        return as_column(col).isNotNull()

    def months_of_year(self, year: Column) -> Column:
        first = F.when(year == F.year(self.start), F.month(self.start)).otherwise(1)
        last = F.when(year == F.year(self.end), F.month(self.end)).otherwise(12)
        return (last - first + 1).cast("int")


def within(rng: DateRange | None, col: Column | str) -> Column:
    """Range predicate; no range means no bound."""
    return F.lit(True) if rng is None else rng.contains(col)


def month_of(col: Column | str) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(as_column(col), "month")


def months_apart(earlier: Column | str, later: Column | str) -> Column:
    """Month boundaries crossed between two days (31 January to 1 February is one)."""
    a, b = as_column(earlier), as_column(later)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("int")


def _to_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value[:10])
