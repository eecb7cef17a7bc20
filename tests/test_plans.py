"""Shape of the plans: what is pushed down, what is shuffled, what never appears."""

from __future__ import annotations

import gc
import re

import pytest

from salesmart import SalesMart, SalesModel
from salesmart.plans.registry import build_queries
from salesmart.session import configure

# Others write tables when they are built.
QUERIES = {n: q for n, q in build_queries().items() if not n.endswith(("_colocated", "_found_again", "_kept", "_in_batches"))}


@pytest.fixture(scope="module")
def plans(spark, tables_dir):
    """Physical plans of all queries, and the number of jobs that building them ran."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    frames = {name: build(spark, tables_dir) for name, build in QUERIES.items()}
    ran = jobs() - before
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    texts = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in frames.items()}
    frames.clear()
    return texts, ran


def test_building_queries_runs_no_job(plans):
    assert plans[1] == 0


@pytest.mark.parametrize("node", ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"])
def test_nodes_that_never_appear(plans, node):
    assert [name for name, text in plans[0].items() if node in text] == []


def test_groups_are_counted_without_row_expansion(plans):
    for name in ("group_kpis_genre", "group_kpis_country", "group_yearly_artist", "monthly_summary", "geo_yearly"):
        assert "Expand" not in plans[0][name]


def test_date_range_reaches_the_scan(spark, tables_dir):
    df = QUERIES["invoice_details_window"](spark, tables_dir)
    text = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "FileScan" in line and "o_orderdate" in line)
    assert "GreaterThanOrEqual(o_orderdate" in scan and "LessThan(o_orderdate" in scan


def test_staging_reads_two_line_columns(plans):
    scan = next(line for line in plans[0]["filtered_invoices"].splitlines() if "l_orderkey" in line and "FileScan" in line)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>", scan)


def test_country_is_only_joined_where_asked_for(plans):
    for name in ("filter_fingerprint", "cohort_retention", "customer_bounds", "date_bounds", "retention_decay"):
        assert "c_custkey" not in plans[0][name]
    assert "c_custkey" in plans[0]["group_kpis_country"]


def test_lines_are_summed_before_their_shuffle(spark, tables_dir):
    """Below the shuffle on the invoice there is a partial sum, even without broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = SalesMart(SalesModel.read_wholesale(spark, tables_dir)).sales
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line.strip(" :+-*()0123456789") for line in text.splitlines()]
    at = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(invoice_id" in line and "HashAggregate" in lines[i + 1])
    assert "partial_sum" in lines[at + 1]


def test_persisted_staging_is_shared(spark, tables_dir):
    mart = SalesMart(SalesModel.read_wholesale(spark, tables_dir)).persist()
    text = mart.retention_kpis()._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in text
    mart.unpersist()


@pytest.mark.parametrize("name", ["topn_artist", "kpi_bundle_long", "topn_all", "insights_compare"])
def test_shared_sets_are_let_go_with_the_result(spark, tables_dir, name):
    held = spark.sparkContext._jsc.sc().getPersistentRDDs
    gc.collect()
    before = held().size()
    result = QUERIES[name](spark, tables_dir)
    result.collect()
    assert held().size() > before
    del result
    gc.collect()
    assert held().size() == before


def test_settings_of_the_caller_stay(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        configure(spark)
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.set(key, before)


def under(lines, at):
    """The lines below a node of a plan's text."""
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    for line in lines[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            return
        yield line


@pytest.mark.parametrize("name", ["top_groups_yearly", "topn_artist", "topn_country", "top_cohorts", "cohort_grid"])
def test_nothing_is_sorted_as_a_whole_below_the_edge(plans, name):
    lines = plans[0][name].splitlines()
    for at, line in enumerate(lines):
        if re.search(r"Aggregate\(|Window |HashJoin|SortMergeJoin", line):
            assert not any("rangepartitioning" in below for below in under(lines, at))


def test_years_are_copied_after_the_first_aggregate(plans):
    lines = plans[0]["geo_frames"].splitlines()
    at = next(k for k, line in enumerate(lines) if "Generate" in line)
    assert any("HashAggregate" in line for line in under(lines, at))
