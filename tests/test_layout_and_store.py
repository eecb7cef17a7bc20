"""Tables in buckets by invoice, and staged sets that other sessions find again."""

from __future__ import annotations

import os
import re
import shutil
from dataclasses import replace
from types import SimpleNamespace

import pytest
from conftest import YEAR, rows
from plan_metrics import nodes

from salesmart import SalesFilter, SalesMart, SalesModel
from salesmart.functions.money import revenue
from salesmart.plans.registry import CHOICE, FILTERED
from salesmart.plans.store import StagedSets
from salesmart.sources.layout import read_layout, write_layout
from salesmart.sources.shared import input_files, shared_folder
from test_plans import under


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def lowest(lines):
    """The last shuffle by customer, which is the one above the first sums."""
    return max(k for k, line in enumerate(lines) if "Exchange hashpartitioning(customer_id" in line)


def scans(df):
    """Text and paths of the scans of a plan that has run."""
    df.collect()
    found = nodes(df._jdf.queryExecution().executedPlan())
    found = [n for n in found if n.getClass().getSimpleName() == "FileSourceScanExec"]
    return [(n.toString(), n.relation().location().rootPaths().mkString(" ")) for n in found]


@pytest.fixture(scope="module")
def layout(spark, tables_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("layout") / "tables")
    write_layout(SalesModel.read_wholesale(spark, tables_dir), folder, 4)
    return folder


@pytest.fixture
def without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("flt", [SalesFilter(), SalesFilter(genres=("ECONOMY",))])
def test_lines_meet_invoices_without_a_shuffle(spark, layout, without_broadcasts, flt):
    lines = planned(SalesMart(read_layout(spark, layout), flt).monthly_summary())
    at = lowest(lines)
    below = list(under(lines, at))
    assert not any("Exchange" in line for line in below)
    scanned = [line for line in below if "FileScan" in line]
    assert len(scanned) == 2 and all("Bucketed: true" in line for line in scanned)
    assert any("Join" in line for line in below)


def test_groups_are_summed_within_buckets(spark, layout, without_broadcasts):
    lines = planned(SalesMart(read_layout(spark, layout)).group_kpis("genre"))
    at = lowest(lines)
    assert not any("Exchange" in line for line in under(lines, at))


def test_plain_tables_do_shuffle(spark, tables_dir, without_broadcasts):
    lines = planned(SalesMart(SalesModel.read_wholesale(spark, tables_dir)).monthly_summary())
    at = lowest(lines)
    assert any("Exchange hashpartitioning(invoice_id" in line for line in under(lines, at))


def test_a_layout_is_read_by_sessions_that_did_not_write_it(spark, layout):
    before = rows(SalesMart(read_layout(spark, layout), CHOICE).monthly_summary())
    for table in spark.catalog.listTables():
        if table.name.startswith("salesmart_"):
            spark.sql(f"DROP TABLE {table.name}")
    assert os.path.isdir(f"{layout}/line")
    assert rows(SalesMart(read_layout(spark, layout), CHOICE).monthly_summary()) == before != []


def test_no_invoice_has_more_rows_than_the_catalog_has_tracks(spark, model, tmp_path):
    hot = model.line.where("invoice_id = 2").crossJoin(spark.range(50)).drop("id")
    copied = replace(model, line=model.line.unionByName(hot))
    folder = str(tmp_path / "hot")
    write_layout(copied, folder, 3)
    read = read_layout(spark, folder)
    assert read.line.where("invoice_id = 2").count() == 2
    mart, own = SalesMart(copied), SalesMart(read)
    sums = ("invoice_id", "dt", "num_lines", "tracks_sold", revenue())
    assert rows(own.sales.orderBy("invoice_id"), *sums) == rows(mart.sales.orderBy("invoice_id"), *sums)
    assert rows(own.core_kpis(YEAR)) == rows(mart.core_kpis(YEAR))
    assert rows(own.group_yearly("artist", YEAR)) == rows(mart.group_yearly("artist", YEAR))
    assert rows(own.catalog_sales("genre")) == rows(mart.catalog_sales("genre"))


def test_a_layout_of_empty_tables(spark, model, tmp_path):
    folder = str(tmp_path / "empty")
    write_layout(replace(model, line=model.line.limit(0), invoice=model.invoice.limit(0)), folder, 2)
    mart = SalesMart(read_layout(spark, folder))
    assert rows(mart.monthly_summary()) == [] and rows(mart.core_kpis()) == []


@pytest.fixture
def own_tables(tables_dir, tmp_path):
    """A copy of the tables that a test may change."""
    for name in ("orders", "lineitem", "part", "customer", "nation"):
        shutil.copy(f"{tables_dir}/{name}.parquet", tmp_path)
    return str(tmp_path)


def test_a_second_session_reads_no_line_table(spark, own_tables, tmp_path):
    folder = str(tmp_path / "store")
    first = SalesMart(SalesModel.read_wholesale(spark, own_tables), CHOICE).stored_in(folder)
    other = spark.newSession()
    again = SalesMart(SalesModel.read_wholesale(other, own_tables), CHOICE).stored_in(folder)
    assert len(os.listdir(f"{folder}/sets")) == 1
    for result in (again.monthly_summary(), again.sales, again.retention_kpis()):
        assert not any("lineitem" in paths for _, paths in scans(result))
    plain = SalesMart(SalesModel.read_wholesale(spark, own_tables), CHOICE)
    assert rows(again.monthly_summary()) == rows(first.monthly_summary()) == rows(plain.monthly_summary()) != []
    assert rows(again.fingerprint()) == rows(plain.fingerprint())


def test_a_changed_file_or_another_filter_stages_anew(spark, own_tables, tmp_path):
    folder = str(tmp_path / "store")

    def mart(flt=CHOICE):
        return SalesMart(SalesModel.read_wholesale(spark, own_tables), flt).stored_in(folder)

    before = mart().invoices.count()
    swapped = SalesFilter(genres=CHOICE.genres, countries=tuple(reversed(CHOICE.countries)))
    assert mart(swapped).invoices.count() == before and len(os.listdir(f"{folder}/sets")) == 1
    mart(SalesFilter(genres=CHOICE.genres))
    assert len(os.listdir(f"{folder}/sets")) == 2
    half = spark.read.parquet(f"{own_tables}/orders.parquet").where("o_orderkey % 2 = 0").toPandas()
    half["o_orderdate"] = half["o_orderdate"].astype("datetime64[us]")
    half.to_parquet(f"{own_tables}/orders.parquet")
    spark.catalog.refreshByPath(own_tables)
    changed = mart()
    assert len(os.listdir(f"{folder}/sets")) == 3
    assert 0 < changed.invoices.count() < before


def test_a_set_without_an_entry_is_staged_again(spark, own_tables, tmp_path):
    """As a writer leaves it that was lost on the way."""
    sets = StagedSets(str(tmp_path / "store"))
    model = SalesModel.read_wholesale(spark, own_tables)
    count = sets.staged(model, CHOICE).count()
    shutil.move(f"{sets.folder}/entries", f"{sets.folder}/lost")
    assert sets.find(spark, sets.key(model, CHOICE)) is None
    assert sets.staged(model, CHOICE).count() == count
    assert len(os.listdir(f"{sets.folder}/sets")) == 2


@pytest.mark.parametrize("result", ["core_kpis", "invoice_details", "total_revenue", "group_yearly"])
def test_a_range_reads_its_months_only(spark, own_tables, tmp_path, result):
    mart = SalesMart(SalesModel.read_wholesale(spark, own_tables)).stored_in(str(tmp_path / "store"))
    plain = SalesMart(SalesModel.read_wholesale(spark, own_tables))
    ask = {
        "core_kpis": lambda m: m.core_kpis(FILTERED.rng),
        "invoice_details": lambda m: m.invoice_details(FILTERED.rng).orderBy("invoice_id"),
        "total_revenue": lambda m: spark.range(1).select(m.total_revenue(FILTERED.rng).alias("x")),
        "group_yearly": lambda m: m.group_yearly("genre", FILTERED.rng),
    }[result]
    own = ask(mart)
    assert rows(own) == rows(ask(plain))
    staged = [text for text, paths in scans(own) if "/sets/" in paths]
    assert staged and all(re.search(r"PartitionFilters: \[[^\]]*staged_month", t) for t in staged)


def test_only_files_tell_that_nothing_has_changed(spark, model):
    with pytest.raises(ValueError):
        input_files(model.line)


def test_a_cluster_without_a_shared_folder_is_told_so():
    nothing = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://somewhere:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)
