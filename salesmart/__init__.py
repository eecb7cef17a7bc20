"""Retail sales analytics as PySpark DataFrame transformations.

Start with a :class:`SalesModel` (four canonical views over your tables), pick a
:class:`SalesFilter`, and ask a :class:`SalesMart` for results. Every result is a
lazy DataFrame: nothing runs until the caller acts on it.
"""

from salesmart.functions.dates import DateRange
from salesmart.operators.filters import SalesFilter
from salesmart.plans.mart import SalesMart
from salesmart.sources.model import SalesModel

__all__ = ["DateRange", "SalesFilter", "SalesMart", "SalesModel"]
