from __future__ import annotations

from conftest import YEAR, rows

from salesmart import DateRange, SalesFilter, SalesMart
from salesmart.functions.fingerprint import frame_fingerprint, key_fingerprint
from salesmart.functions.money import revenue
from salesmart.operators.staging import staged_invoices, staged_sales


def staged_ids(model, flt):
    return sorted(r[0] for r in rows(staged_invoices(model, flt), "invoice_id"))


def test_no_filter_drops_invoices_without_a_complete_line(model):
    # 15 has no lines, 16 only an item without genre.
    assert staged_ids(model, SalesFilter()) == [*range(1, 15), 17]


def test_genre_filter_selects_invoices_and_keeps_all_their_lines(model):
    flt = SalesFilter(genres=("Rock",))
    sales = {r[0]: r[1:] for r in rows(staged_sales(model, flt), "invoice_id", "num_lines", revenue())}
    assert sorted(sales) == staged_ids(model, flt)
    assert sales[2][0] == 2 and float(sales[2][1]) == 4.0
    assert 3 not in sales


def test_filters_are_conjunctive_on_the_same_line(model):
    assert staged_ids(model, SalesFilter(genres=("Rock",), artists=("Y",))) == []
    assert staged_ids(model, SalesFilter(genres=("Jazz",), countries=("USA", "France"))) == [2, 3, 5]
    assert staged_ids(model, SalesFilter(countries=("O'Reilly",))) == []


def test_dates_in_a_filter_are_widened_to_months(model):
    flt = SalesFilter(dates=DateRange.of("2010-01-15", "2010-02-01"))
    assert staged_ids(model, flt) == [7, 8, 14]


def test_both_staging_forms_agree(model):
    for flt in (SalesFilter(), SalesFilter(genres=("Jazz",)), SalesFilter(countries=("Brazil",))):
        with_totals = sorted(r[0] for r in rows(staged_sales(model, flt), "invoice_id"))
        assert with_totals == staged_ids(model, flt)


def test_details_use_whole_months_and_no_range_means_all(mart):
    march = DateRange.of("2010-03-20", "2010-03-20")
    assert rows(mart.invoice_details(march), "invoice_id", "country") == [(4, "France")]
    assert mart.invoice_details().count() == 15


def test_fingerprint_ignores_order_and_duplicates(spark):
    digest = lambda ids: rows(key_fingerprint(spark.createDataFrame([(i,) for i in ids], "id long"), "id"))
    assert digest([3, 1, 2]) == digest([1, 2, 2, 3, 3])
    assert digest([1, 2]) != digest([1, 3])
    assert digest([1, 2]) != digest([12])


def test_frame_fingerprint_counts_duplicates_and_ignores_order(spark):
    frame = lambda data: rows(frame_fingerprint(spark.createDataFrame(data, "a long, b double")))
    assert frame([(1, 0.5), (2, None)]) == frame([(2, None), (1, 0.5)])
    assert frame([(1, 0.5)]) != frame([(1, 0.5), (1, 0.5)])


def test_same_filter_keeps_the_stored_mart(mart):
    assert mart.with_filter(SalesFilter()) is mart
    assert mart.with_filter(SalesFilter(genres=("Rock",))) is not mart


def test_views_are_registered(spark, mart):
    mart.register("staged_view")
    assert mart.is_registered("staged_view")
    assert not mart.is_registered("some_other_view")
    assert spark.table("staged_view").count() == 15


def test_checkpointed_staging_gives_the_same_results(spark, model, mart, tmp_path):
    if spark.conf.get("spark.checkpoint.dir", "") == "" and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    stored = SalesMart(model).checkpoint()
    assert rows(stored.core_kpis(YEAR)) == rows(mart.core_kpis(YEAR))
