"""Division that yields null instead of raising on a zero or missing divisor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesmart.functions.dates import as_column


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    top = as_column(numerator).cast("double")
    bottom = as_column(denominator).cast("double")
    return F.try_divide(top, bottom)
