from __future__ import annotations

from datetime import date

import pytest
from conftest import YEAR, rows

from salesmart import DateRange
from salesmart.operators.geo import metric_bounds, with_iso3
from salesmart.operators.series import revenue_per_customer


def test_monthly_summary(mart):
    got = {r[0]: r[1:] for r in rows(mart.monthly_summary(YEAR))}
    assert len(got) == 8
    # purchases, customers, tracks, revenue, first-timers
    assert got["2010-07"] == (2, 1, 4, 5.0, 1)
    # A bought before, so June has no first-timer although it lies inside the range.
    assert got["2010-06"] == (1, 1, 3, 4.0, 0)
    # D's second invoice, a day later, falls into the next month.
    assert got["2010-02"] == (1, 1, 1, 1.0, 0)


def test_monthly_range_is_by_day(mart):
    got = rows(mart.monthly_summary(DateRange.of("2010-02-01", "2010-02-01")), "month", "num_purchases")
    assert got == [("2010-02", 1)]
    # The first month counts as first even where the range starts after the first day.
    got = rows(mart.monthly_summary(DateRange.of("2010-07-07", "2010-07-07")), "first_time_customers")
    assert got == [(1,)]


def test_revenue_per_customer(mart):
    row = revenue_per_customer(mart.monthly_summary(YEAR)).where("month = '2010-01'").first()
    assert row["rev_per_cust"] == pytest.approx(1.0)


def test_geo_yearly_and_aggregate_add_up_to_frames(mart):
    span = DateRange.of("2009-03-15", "2011-02-20")
    yearly, whole = rows(mart.geo_metrics(span)), rows(mart.geo_metrics(span, "aggregate"))
    assert rows(mart.geo_metrics(span, "frames")) == yearly + whole
    assert {r[0] for r in whole} == {"All"}


def test_geo_first_timers_follow_the_first_day_in_range(mart):
    span = DateRange.of("2010-01-01", "2011-12-31")
    got = {(r[0], r[2]): r[3:] for r in rows(mart.geo_metrics(span))}
    assert got[("2010", "USA")] == (4, 5, 8, 9.0, 4)
    assert got[("2011", "USA")] == (2, 2, 2, 3.0, 0)
    assert got[("2010", "France")][4] == 2


@pytest.mark.parametrize(
    ("start", "end", "months"),
    [
        ("2010-03-01", "2010-11-30", {"2010": 9, "All": 9}),
        ("2009-05-01", "2011-04-30", {"2009": 8, "2010": 12, "2011": 4, "All": 24}),
        ("2009-05-10", "2010-05-09", {"2009": 8, "2010": 5, "All": 12}),
        ("2009-05-10", "2010-07-20", {"2009": 8, "2010": 7, "All": 15}),
    ],
)
def test_months_covered(mart, start, end, months):
    got = rows(mart.geo_metrics(DateRange.of(start, end), "frames"), "year", "num_months")
    assert {y: m for y, m in got if y in months} == {y: m for y, m in months.items() if y in dict(got)}
    assert dict(got)["All"] == months["All"]


def test_full_months_at_month_ends():
    assert DateRange.of("2021-01-31", "2021-02-28").full_months == 2
    assert DateRange.of("2021-01-31", "2021-03-30").full_months == 2
    assert DateRange.of("2021-01-15", "2021-01-15").full_months == 1
    assert DateRange.of("2020-02-10", "2020-02-11").month_aligned() == DateRange(date(2020, 2, 1), date(2020, 2, 29))


def test_unknown_mode_is_rejected(mart):
    with pytest.raises(ValueError):
        mart.geo_metrics(YEAR, "daily")


def test_iso_codes_drop_unknown_countries_only(mart, codes):
    whole = mart.geo_metrics(DateRange.of("2009-01-01", "2011-12-31"), "aggregate")
    assert "Atlantis" in {r[0] for r in rows(whole, "country")}
    got = dict(rows(with_iso3(whole, codes), "country", "iso_alpha"))
    assert got == {"USA": "USA", "France": "FRA", "Brazil": "BRA"}


def test_countries_resolve_by_name_or_code(spark, codes):
    given = spark.createDataFrame([("usa",), ("FR",), ("Brazil",), ("Atlantis",)], "country string")
    assert sorted(rows(with_iso3(given, codes))) == [("Brazil", "BRA"), ("FR", "FRA"), ("usa", "USA")]


def test_metric_bounds(mart):
    got = {r[0]: r[1:] for r in rows(metric_bounds(mart.geo_metrics(YEAR)))}
    assert got["revenue"] == (3.0, 9.0)
    assert got["num_purchases"] == (2.0, 5.0)


def test_empty_selection(empty_mart):
    assert rows(empty_mart.monthly_summary(YEAR)) == []
    assert rows(empty_mart.geo_metrics(YEAR, "frames")) == []
