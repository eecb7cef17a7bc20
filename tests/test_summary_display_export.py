from __future__ import annotations

import csv
import os
from datetime import date

import pytest
from conftest import YEAR, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from salesmart import DateRange, SalesModel
from salesmart.functions.display import country_label, display
from salesmart.operators.summary import date_bounds, filter_values, static_summary
from salesmart.plans.bundle import kpi_bundle, topn_all
from salesmart.plans.insights import insights_compare
from salesmart.sources.export import export_csv


def test_static_summary(model):
    assert dict(rows(static_summary(model))) == {
        "Date Range": "Jan 2009 – Apr 2011",
        "Number of Purchases": "17",
        "Number of Customers": "9",
        "Tracks Sold": "18",
        "Total Revenue (USD$)": "$43.00",
        "Number of Genres": "3",
        "Number of Artists": "3",
        "Number of Countries": "4",
    }


def test_filter_choices(model):
    got = rows(filter_values(model))
    assert [v for k, v in got if k == "genre"] == ["Jazz", "Opera", "Rock"]
    assert [v for k, v in got if k == "country"] == ["Atlantis", "Brazil", "France", "USA"]
    assert rows(date_bounds(model)) == [(date(2009, 1, 1), date(2011, 4, 1))]


@pytest.mark.parametrize(
    ("value", "kind", "text"),
    [
        (1234.567, "dollar", "$1,234.57"),
        (0.1234, "percent", "12.34%"),
        (12.5, "percent", "1250.00%"),
        (1000000.0, "number", "1,000,000"),
        (1234.5, "number", "1,234.50"),
        (1234.567, "float", "1,234.57"),
        (94.0, "float", "94.00"),
        (None, "dollar", "NA"),
        (None, "number", "NA"),
    ],
)
def test_display(spark, value, kind, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert rows(df.select(display("x", kind))) == [(text,)]


def test_unknown_display_kind():
    with pytest.raises(ValueError):
        display(F.lit(1), "unknown")


def test_country_label(spark):
    df = spark.createDataFrame([("us", "United States"), ("FR", None), (None, "Nowhere")], "iso2 string, name string")
    assert rows(df.select(country_label("iso2"))) == [("🇺🇸",), ("🇫🇷",), ("NA",)]
    assert rows(df.select(country_label("iso2", "name"))) == [("🇺🇸 United States",), ("🇫🇷",), ("NA",)]


def test_bundle(mart):
    got = {(r[0], r[1]): r[2:] for r in rows(kpi_bundle(mart, YEAR, offsets=(1, 2)))}
    assert got[("metadata_kpis", "revenue_total")] == (17.0, "$17.00")
    assert got[("topn_genre", "num_vals")] == (2.0, "2")
    assert got[("retention_kpis", "cust_line")] == (None, "7 (71.43%)")
    assert got[("retention_kpis", "med_gap_window")] == (1.0, "1.00")
    assert got[("retention_kpis", "top_cohort_line_1")] == (None, "Jan 2010 (50.00%)")
    assert got[("retention_kpis", "top_cohort_line_2")] == (None, "NA (NA)")
    assert len(got) == 13 + 3 + 20 + 5 + 6


def test_bundle_is_empty_without_invoices(empty_mart):
    assert rows(kpi_bundle(empty_mart, YEAR)) == []
    assert rows(topn_all(empty_mart, YEAR)) == []


def test_bundle_without_customers_in_the_raw_range(mart):
    # The month has an invoice, the raw range has none: core figures only.
    got = {r[0] for r in rows(kpi_bundle(mart, DateRange.of("2010-03-10", "2010-03-20")), "section")}
    assert "metadata_kpis" in got and "retention_kpis" not in got


def test_all_rankings(mart, codes):
    got = topn_all(mart, YEAR, countries=codes)
    assert rows(got.groupBy("section").count().orderBy("section")) == [
        ("topn_artist", 10),
        ("topn_country", 15),
        ("topn_genre", 10),
    ]


def test_insights(mart, empty_mart, codes):
    full = DateRange.of("2009-01-01", "2011-12-31")
    got = insights_compare(mart, full, mart, YEAR, codes).where("scope = 'Filtered View'")
    cards = {(r.label, r.rank): (r.card, r.name, r.value_fmt) for r in got.collect()}
    assert cards[("Total Revenue", 1)] == ("revenue", None, "$17.00")
    assert cards[("Top Markets", 1)] == ("revenue", "🇺🇸 United States", "$9.00")
    assert cards[("Top Genre", 1)][1:] == ("Rock", "$10.00")
    assert ("Top Markets", 3) in cards and ("Top Genre", 2) not in cards
    assert cards[("Total Orders", 1)] == ("purchases", None, "10")
    assert cards[("Top 3-Month Retention", 1)][0] == "customers"
    alone = insights_compare(mart, full, empty_mart, YEAR, codes)
    assert rows(alone.select("scope").distinct()) == [("All Data",)]


def test_csv_export(mart, tmp_path):
    path = export_csv(mart.monthly_summary(YEAR), str(tmp_path), "ts", day=date(2024, 5, 6))
    assert path.endswith("sales_ts_2024_05_06.csv")
    lines = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".csv"):
            with open(os.path.join(path, name), newline="") as f:
                lines += list(csv.reader(f))
    assert lines[0][0] == "month" and ["2010-07", "2", "1", "4", "5.0", "1"] in lines


def test_csv_export_of_nothing_writes_nothing(empty_mart, tmp_path):
    assert export_csv(empty_mart.monthly_summary(YEAR), str(tmp_path), "ts") is None
    assert os.listdir(tmp_path) == []


def test_missing_tables_raise(spark):
    with pytest.raises(AnalysisException):
        SalesModel.read_wholesale(spark, "/nowhere/at/all")
