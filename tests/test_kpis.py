from __future__ import annotations

import pytest
from conftest import YEAR, rows

from salesmart import DateRange, SalesFilter, SalesMart
from salesmart.operators.groups import display_top_n, enrich_top_n, top_n, yearly_ratios


def test_core_kpis(mart):
    row = mart.core_kpis(DateRange.of("2010-01-10", "2010-12-01")).first().asDict()
    # In range: 2, 4-8, 11, 12, 14, 17; customers A B C D E G I; A and E bought before.
    assert row["purchases_num"] == 10
    assert row["cust_num"] == 7
    assert row["cust_num_new"] == 5
    assert row["cust_per_new"] == pytest.approx(5 / 7)
    assert row["tracks_sold_num"] == 15
    assert row["revenue_total"] == 17.0
    assert row["revenue_per_month"] == pytest.approx(17 / 12)
    assert row["revenue_per_purchase"] == pytest.approx(1.7)
    assert (row["genre_num"], row["artist_num"], row["country_num"]) == (2, 2, 3)


def test_core_new_customers_look_at_unstaged_invoices(model):
    # Staged by jazz, E's first jazz invoice is 10; C's is 5; A's is 2, but A bought in 2009.
    jazz = SalesMart(model, SalesFilter(genres=("Jazz",)))
    row = jazz.core_kpis(YEAR).first()
    assert (row["cust_num"], row["cust_num_new"]) == (3, 1)


def test_core_is_empty_without_invoices(mart, empty_mart):
    assert rows(empty_mart.core_kpis(YEAR)) == []
    assert rows(mart.core_kpis(DateRange.of("1999-01-01", "1999-12-31"))) == []


def test_group_kpis_by_genre(mart):
    got = {r[0]: r[1:] for r in rows(mart.group_kpis("genre", YEAR))}
    # customers, purchases, tracks, revenue, first-timers
    assert got == {"Jazz": (3, 4, 4, 6.0, 3), "Rock": (6, 7, 10, 10.0, 6)}


def test_group_kpis_by_artist_counts_lines_without_genre(mart):
    got = {r[0]: r[1:] for r in rows(mart.group_kpis("artist", YEAR))}
    assert got["X"] == (6, 7, 11, 11.0, 6)


def test_group_kpis_by_country(mart):
    got = {r[0]: r[1:] for r in rows(mart.group_kpis("country", YEAR))}
    # C buys in two countries on the first day and is a first-timer of both.
    assert got["France"] == (2, 2, 2, 3.0, 2)
    assert got["Brazil"] == (2, 3, 5, 5.0, 2)
    assert got["USA"] == (4, 5, 8, 9.0, 4)


def test_group_first_timers_are_by_day(mart):
    # Over all time A B C D F G I start with rock, C (same day) and E with jazz.
    got = {r[0]: r[1] for r in rows(mart.group_kpis("genre"), "group_val", "first_time_customers")}
    assert got == {"Jazz": 2, "Rock": 7}


def test_unknown_group_is_rejected(mart):
    with pytest.raises(ValueError):
        mart.group_kpis("album", YEAR)
    with pytest.raises(ValueError):
        mart.catalog("country")


def test_catalog_and_coverage(mart):
    assert rows(mart.catalog("genre")) == [("Jazz", 1), ("Rock", 3)]
    assert rows(mart.catalog("artist")) == [("X", 2), ("Y", 1), ("Z", 1)]
    got = rows(mart.catalog_sales("genre", YEAR))
    assert got[0] == ("Jazz", 1, 1, 1.0)
    assert got[1][:3] == ("Rock", 1, 3) and got[1][3] == pytest.approx(1 / 3)


def test_group_yearly(mart):
    got = {r[:2]: r[2:] for r in rows(mart.group_yearly("genre", DateRange.of("2009-01-01", "2011-12-31")))}
    # customers, purchases, countries, tracks, revenue, new customers, tracks, new tracks, catalog
    assert got[("2009", "Rock")] == (2, 2, 2, 2, 2.0, 2, 1, 1, 3)
    assert got[("2010", "Rock")] == (6, 7, 3, 10, 10.0, 5, 1, 0, 3)
    assert got[("2010", "Jazz")] == (3, 4, 3, 4, 6.0, 1, 1, 0, 1)
    assert got[("2011", "Jazz")] == (1, 1, 1, 1, 2.0, 0, 1, 0, 1)


def test_group_yearly_dates_are_raw(mart):
    got = rows(mart.group_yearly("genre", DateRange.of("2010-06-16", "2010-07-06")))
    assert got == []


def test_yearly_ratios(mart):
    row = yearly_ratios(mart.group_yearly("genre", YEAR)).where("genre = 'Rock'").first()
    assert row["revenue_per_track"] == pytest.approx(10 / 3)
    assert row["pct_catalog_sold"] == pytest.approx(1 / 3)


def test_top_groups_yearly_keeps_all_years_of_the_best(mart):
    span = DateRange.of("2009-01-01", "2011-12-31")
    got = rows(mart.top_groups_yearly("artist", span, "tracks_sold", 1), "year", "artist")
    assert got == [("2009", "X"), ("2010", "X"), ("2011", "X")]
    with pytest.raises(KeyError):
        mart.top_groups_yearly("artist", span, "wrong_key")


@pytest.fixture
def ranked(spark):
    return spark.createDataFrame(
        [("A", 100, 10), ("B", 200, 20), ("C", 150, 15), ("D", 50, 5), ("E", 300, 30), ("F", 200, None)],
        "group_val string, revenue int, tracks_sold int",
    )


def test_top_n_orders_by_value_then_name(ranked):
    got = rows(top_n(ranked, 3, ["revenue"]).orderBy("rank"), "rank", "group_val")
    assert got == [(1, "E"), (2, "B"), (3, "F")]


def test_top_n_ranks_each_metric_and_skips_nulls(ranked):
    got = rows(top_n(ranked, 9, ["revenue", "tracks_sold"]).groupBy("metric").count().orderBy("metric"))
    assert got == [("revenue", 6), ("tracks_sold", 5)]


def test_top_n_rejects_unknown_metrics(ranked):
    with pytest.raises(KeyError):
        top_n(ranked, 3, ["wrong_key"])


def test_revenue_share_falls_back_to_the_slice(mart):
    groups = mart.group_kpis("genre", YEAR)
    alone = enrich_top_n(top_n(groups, 1, ["revenue"]))
    assert rows(alone, "revenue_share") == [(1.0,)]
    shares = rows(mart.top_n("genre", YEAR, metrics=["revenue"]).orderBy("rank"), "group_val", "revenue_share")
    assert shares == [("Rock", pytest.approx(10 / 17)), ("Jazz", pytest.approx(6 / 17))]


def test_top_n_is_enriched_and_displayed(mart, codes):
    row = display_top_n(mart.top_n("genre", YEAR)).where("metric = 'revenue' AND rank = 1").first()
    assert row["avg_revenue_per_cust_fmt"] == "$1.67"
    assert row["pct_catalog_sold_fmt"] == "33.33%"
    assert row["avg_tracks_per_purchase_fmt"] == "1.43"
    assert row["tracks_sold_fmt"] == "10"
    assert row["group_val_fmt"] == "Rock"
    shown = display_top_n(mart.top_n("country", metrics=["revenue"]), codes)
    names = dict(rows(shown, "group_val", "group_val_fmt"))
    assert names["USA"] == "🇺🇸 United States"
    assert names["Atlantis"] == "NA"


def test_groups_of_an_empty_selection_are_empty(empty_mart):
    for by in ("genre", "artist", "country"):
        assert rows(empty_mart.group_kpis(by, YEAR)) == []
        assert rows(empty_mart.top_n(by, YEAR)) == []
    assert rows(empty_mart.catalog_sales("artist", YEAR)) == []
    assert rows(empty_mart.group_yearly("genre", YEAR)) == []
