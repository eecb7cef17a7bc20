from __future__ import annotations

from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from salesmart.functions.money import revenue, sum_amounts, sum_revenue, units_of_decimal, units_of_double


def test_units(spark):
    df = spark.createDataFrame([(0.1 + 0.2, "1.15"), (1234.5678, "-0.01")], "d double, p string")
    got = rows(df.select(units_of_double(F.col("d")), units_of_decimal(F.col("p").cast("decimal(10,2)"))))
    assert got == [(3000, 11500), (12345678, -100)]


def test_sums_are_exact_beyond_a_long(spark):
    big = 9_000_000_000_000_000_001
    df = spark.createDataFrame([(1, big), (1, big), (1, -7), (2, 5)], "k long, amount long")
    total = df.groupBy("k").agg(*sum_amounts("amount")).agg(*sum_revenue()).select(revenue())
    assert rows(total) == [(Decimal(2 * big - 2) / 10_000,)]


def test_conditional_sum(spark):
    df = spark.createDataFrame([(1, 10_000), (2, 50_000)], "k long, amount long")
    parts = df.groupBy("k").agg(*sum_amounts("amount")).agg(*sum_revenue(F.col("k") == 2))
    assert rows(parts.select(revenue())) == [(Decimal(5),)]
