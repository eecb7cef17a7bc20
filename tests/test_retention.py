from __future__ import annotations

from datetime import date

import pytest
from conftest import YEAR, rows

from salesmart import DateRange
from salesmart.operators.cohorts import cohort_grid, cohort_matrix, decay_percent, top_cohorts

A, B, C, D, E, F, G, H, I = range(1, 10)


@pytest.fixture(scope="module")
def metrics(mart):
    return {r["customer_id"]: r for r in mart.customer_metrics(YEAR).collect()}


def test_bounds_cover_customers_of_the_window(metrics):
    assert set(metrics) == {A, B, C, D, E, G, I}


def test_bounds_on_both_sides(metrics):
    r = metrics[A]
    assert (r.first_date, r.second_date, r.last_date) == (date(2009, 5, 10), date(2010, 6, 15), date(2011, 2, 20))
    assert (r.last_before_window, r.first_after_window) == (date(2009, 5, 10), date(2011, 2, 20))
    assert (r.num_in_window, r.second_in_window) == (1, None)
    assert r.repeat_ret and not r.cust_new and not r.repeat_conv
    assert r.lifespan_mo_window == 11 and r.lifespan_mo_total == 21
    assert r.avg_gap_bound == pytest.approx((date(2011, 2, 20) - date(2009, 5, 10)).days / 2)


def test_single_purchase(metrics):
    r = metrics[B]
    assert r.cust_new and r.repeat_conv and not r.repeat_any and not r.repeat_window
    assert (r.lifespan_mo_total, r.lifespan_mo_window, r.gap_life, r.gap_window) == (None, None, None, None)
    assert (r.avg_gap_life, r.avg_gap_window, r.avg_gap_bound) == (None, None, None)


def test_two_purchases_on_one_day(metrics):
    r = metrics[C]
    assert r.second_date == r.first_date == r.second_in_window == date(2010, 7, 7)
    assert (r.gap_life, r.gap_window, r.avg_gap_window, r.lifespan_mo_window) == (0, 0, 0.0, 0)
    assert r.repeat_window


def test_new_with_later_purchase(metrics):
    r = metrics[D]
    assert r.gap_window == 1 and r.repeat_conv
    assert r.lifespan_mo_window == 11
    assert r.gap_retention == (date(2011, 4, 1) - date(2010, 2, 1)).days
    assert r.avg_gap_bound == pytest.approx((date(2011, 4, 1) - date(2010, 1, 31)).days / 2)


def test_returning_without_later_purchase(metrics):
    r = metrics[E]
    assert r.gap_winback == (date(2010, 10, 1) - date(2009, 12, 31)).days
    assert r.lifespan_mo_window == 10
    assert r.avg_gap_bound == pytest.approx((date(2010, 11, 30) - date(2009, 12, 31)).days / 2)


def test_second_purchase_after_the_window_is_not_inside(mart):
    rng = DateRange.of("2010-01-01", "2010-01-31")
    got = dict(rows(mart.customer_bounds(rng), "customer_id", "second_in_window"))
    assert got == {D: None, G: None}


def test_strict_conversion_asks_for_a_later_purchase(mart):
    got = dict(rows(mart.customer_metrics(YEAR, strict=True), "customer_id", "repeat_conv"))
    assert (got[B], got[C], got[D], got[A]) == (False, True, True, False)


def test_no_range_takes_everything_as_window(mart):
    got = {r["customer_id"]: r for r in mart.customer_metrics().collect()}
    assert got[F].cust_new and got[A].num_in_window == 3
    assert got[A].lifespan_mo_window == got[A].lifespan_mo_total == 21


def test_retention_kpis(mart):
    r = mart.retention_kpis(YEAR).first()
    assert (r.num_cust, r.num_new, r.ret_n_any, r.ret_n_return, r.ret_n_conv, r.ret_n_window) == (7, 5, 4, 2, 5, 3)
    assert r.ret_rate_return == 1.0 and r.pct_new == pytest.approx(5 / 7)
    assert r.med_gap_window == 1.0
    assert r.avg_life_mo_win == pytest.approx((11 + 0 + 11 + 10) / 4)


def test_rates_without_divisor_are_null(mart):
    only_returning = mart.retention_kpis(DateRange.of("2010-06-01", "2010-06-30")).first()
    assert only_returning.num_new == 0 and only_returning.ret_rate_conv is None
    only_new = mart.retention_kpis(DateRange.of("2010-03-01", "2010-03-31")).first()
    assert only_new.ret_rate_return is None


def test_cohorts_use_all_invoices_for_month_and_size(mart):
    got = rows(mart.cohort_retention(YEAR))
    jan10 = date(2010, 1, 1)
    # G's February invoice has no lines: it is not staged, so only D is active there.
    assert (jan10, 1, 1, 2, 0.5) in got
    assert (date(2009, 5, 1), 13, 1, 1, 1.0) in got
    assert all(offset > 0 for _, offset, *_ in got)


def test_month_offset_counts_boundaries(mart):
    got = {(r[0], r[1]) for r in rows(mart.cohort_retention(DateRange.of("2010-02-01", "2010-02-01")))}
    assert got == {(date(2010, 1, 1), 1)}


def test_max_offset(mart):
    assert {r[1] for r in rows(mart.cohort_retention(YEAR, 1))} == {1}
    span = {r[1] for r in rows(mart.cohort_retention(DateRange.of("2009-01-01", "2011-12-31")))}
    assert max(span) == 21
    assert {r[0] for r in rows(mart.retention_decay(YEAR, 10))} == {1, 10}


def test_decay_divides_by_the_active_customers(mart):
    got = {r[0]: r[1:] for r in rows(mart.retention_decay(YEAR))}
    assert got[1] == (1, 7, pytest.approx(1 / 7))
    # A customer first active beyond the limit is not in the divisor.
    assert rows(mart.retention_decay(YEAR, 1), "num_customers") == [(5,)]
    assert rows(decay_percent(mart.retention_decay(YEAR, 1)), "retention_rate") == [(20.0,)]


def test_top_cohorts_prefer_the_earliest_and_keep_missing_offsets(spark):
    data = [
        (date(2010, 2, 1), 3, 0.5),
        (date(2010, 1, 1), 3, 0.5),
        (date(2010, 3, 1), 3, 0.4),
        (date(2010, 3, 1), 9, 0.1),
    ]
    cohorts = spark.createDataFrame(data, "cohort_month date, month_offset int, retention_pct double")
    assert rows(top_cohorts(cohorts)) == [(3, date(2010, 1, 1), 0.5), (6, None, None), (9, date(2010, 3, 1), 0.1)]


def test_grid_is_dense_and_matrix_in_time_order(mart):
    cohorts = mart.cohort_retention(YEAR)
    grid = cohort_grid(cohorts)
    assert grid.count() == 9 * 13  # May 2009 to January 2010, offsets 1 to 13
    cells = {(r[0], r[1]): r[2] for r in rows(grid, "cohort_label", "month_offset", "retention_pct")}
    assert cells[("Jan 2010", 1)] == 50.0 and cells[("Jun 2009", 1)] is None
    matrix = rows(cohort_matrix(grid), "cohort_label", "offsets", "retention_pct")
    assert [r[0] for r in matrix[:2]] == ["May 2009", "Jun 2009"]
    assert all(r[1] == list(range(1, 14)) for r in matrix)
    assert matrix[0][2][12] == 100.0 and (matrix[-1][0], matrix[-1][2][0], matrix[-1][2][12]) == ("Jan 2010", 50.0, None)


def test_empty_selection(empty_mart):
    assert rows(empty_mart.customer_bounds(YEAR)) == []
    assert rows(empty_mart.retention_kpis(YEAR)) == []
    assert rows(empty_mart.cohort_retention(YEAR)) == []
    assert rows(empty_mart.retention_decay(YEAR)) == []
    assert rows(cohort_grid(empty_mart.cohort_retention(YEAR))) == []
