"""Lines that no selected invoice can hold end at the scan."""

from __future__ import annotations

import pytest
from plan_metrics import shuffled
from pyspark.sql import functions as F

from salesmart import SalesFilter, SalesMart, SalesModel
from salesmart.functions.key_filter import key_filter
from salesmart.operators.staging import LEAST_BYTES
from salesmart.plans.registry import FILTERED, build_queries, mart_for

QUERIES = build_queries()


@pytest.fixture(autouse=True)
def without_broadcasts(spark):
    """As on tables too large to send around."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(LEAST_BYTES[0], "0")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset(LEAST_BYTES[0])


@pytest.mark.parametrize("name", ["group_kpis_genre", "group_kpis_artist", "group_yearly_genre", "group_yearly_artist", "catalog_sales_artist"])
def test_shuffled_lines_are_in_proportion_to_the_selection(spark, tables_dir, name):
    mart = mart_for(spark, tables_dir, FILTERED.filter)
    chosen = mart.invoices.where(FILTERED.rng.month_aligned().contains("dt"))
    own = mart.model.line.join(chosen, "invoice_id", "left_semi").count()
    whole = mart.model.line.count()
    candidates = FILTERED.filter.invoices(mart.model).select("invoice_id")
    near = mart.model.line.join(candidates, "invoice_id", "left_semi").count()
    items, invoices = mart.model.item.count(), mart.model.invoice.count()
    assert own < whole / 20
    found = [(t, r) for t, r in shuffled(QUERIES[name + "_filtered"](spark, tables_dir)) if r and "hashpartitioning(word" not in t]
    # Tables of invoices and items are shuffled too. Beyond these, lines of the selected
    # countries look for their items, and hardly any others.
    assert max(r for t, r in found) <= max(invoices, items, near * 1.1)
    with_group = [r for t, r in found if "group_val" in t and "invoice_id" in t]
    assert all(r <= own * 1.1 for r in with_group)


def test_small_tables_are_shuffled_whole(spark, tables_dir):
    spark.conf.unset(LEAST_BYTES[0])
    mart = mart_for(spark, tables_dir, FILTERED.filter)
    sums = [r for t, r in shuffled(mart.group_kpis("genre")) if "group_val" in t and "invoice_id" in t]
    assert sums and max(sums) > mart.model.line.count() / 2


def test_nothing_selected_leaves_no_line(spark, tables_dir):
    mart = SalesMart(SalesModel.read_wholesale(spark, tables_dir), SalesFilter(countries=("NOWHERE",)))
    rows = [r for t, r in shuffled(mart.group_kpis("genre")) if "group_val" in t and "invoice_id" in t]
    assert sum(r or 0 for r in rows) == 0


@pytest.mark.parametrize("number", [1, 64, 1 << 12])
def test_no_key_is_missed(spark, number):
    keys = spark.range(0, 3000, 3).withColumn("id", F.when(F.col("id") == 9, None).otherwise(F.col("id")))
    held = key_filter(keys, "id", number)
    assert spark.range(3000).where("id % 3 = 0 AND id <> 9").where(~held.may_hold("id")).count() == 0
    assert spark.range(3000).where("id % 3 = 0").select(F.lit(None).cast("long").alias("id")).where(~held.may_hold("id")).count() == 0
    passed = spark.range(3000).where("id % 3 <> 0").where(held.may_hold("id")).count()
    assert passed == 2000 if number == 1 else passed < (200 if number == 1 << 12 else 2001)


def test_the_number_of_words_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        key_filter(spark.range(3), "id", 48)
