"""Display text for KPI values, built from SQL functions so it stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesmart.functions.dates import as_column

# The text for a missing value and the number patterns.
MISSING = "NA"
GROUPED = "#,##0.00"
PLAIN = "0.00"
WHOLE = "#,##0"

# Letters and the regional indicators that draw a flag.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
INDICATORS = "🇦🇧🇨🇩🇪🇫🇬🇭🇮🇯🇰🇱🇲🇳🇴🇵🇶🇷🇸🇹🇺🇻🇼🇽🇾🇿"


def _pattern(col: Column, pattern: str) -> Column:
    return F.call_function("format_number", col, F.lit(pattern))


def dollar(col: Column | str, prefix: str = "$") -> Column:
    """``$1,234.57``"""
    return _or_missing(F.concat(F.lit(prefix), _pattern(as_column(col).cast("double"), GROUPED)))


def percent(col: Column | str) -> Column:
    """``12.34%`` from the fraction 0.1234, without digit grouping."""
    return _or_missing(F.concat(_pattern(as_column(col).cast("double") * 100, PLAIN), F.lit("%")))


def decimal(col: Column | str) -> Column:
    """``1,234.57``, always two decimals."""
    return _or_missing(_pattern(as_column(col).cast("double"), GROUPED))


def number(col: Column | str) -> Column:
    """Grouped digits; decimals only where the value has a fraction."""
    value = as_column(col).cast("double")
    return _or_missing(
        F.when(value == F.floor(value), _pattern(value, WHOLE)).otherwise(_pattern(value, GROUPED))
    )


def flag(iso2: Column | str) -> Column:
    """Flag symbol of a two-letter country code."""
    return F.translate(F.upper(as_column(iso2)), LETTERS, INDICATORS)


def country_label(iso2: Column | str, label: Column | str | None = None) -> Column:
    """Flag, then the label when there is one; missing text when the code is unknown."""
    code = as_column(iso2)
    text = flag(code) if label is None else F.concat_ws(" ", flag(code), as_column(label))
    return F.when(F.length(code) == 2, text).otherwise(F.lit(MISSING))


_KINDS = {"dollar": dollar, "percent": percent, "float": decimal, "number": number}


def display(col: Column | str, kind: str) -> Column:
    """Format ``col`` as one of dollar, percent, float or number."""
    if kind not in _KINDS:
        raise ValueError(f"unknown display kind: {kind}")
    return _KINDS[kind](col)


def _or_missing(text: Column) -> Column:
    return F.coalesce(text, F.lit(MISSING))
