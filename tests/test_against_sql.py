"""Every registered query against its SQL twin, run by another engine."""

from __future__ import annotations

import collections
import math
import os
from datetime import date

import duckdb
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from salesmart import DateRange, SalesFilter, SalesMart, SalesModel
from salesmart.operators.staging import LEAST_BYTES
from salesmart.plans.oracle import build_oracle
from salesmart.plans.registry import CHOICE, build_queries
from salesmart.sources.schemas import WHOLESALE
from salesmart.sources.tables import load_tables

QUERIES, SQL = build_queries(), build_oracle()
TABLES = "region nation customer supplier part orders lineitem".split()


def connect(directory):
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(directory, f"{table}.parquet")
        if os.path.exists(path):
            files = os.path.join(path, "*.parquet") if os.path.isdir(path) else path
            con.sql(f"CREATE VIEW {table} AS FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4) + 0.0
    return value


def same(spark, con, directory, name):
    df = QUERIES[name](spark, directory)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return len(got)


@pytest.fixture(scope="module")
def small_dir():
    path = os.path.join(TESTDATA, "sf0.001")
    if not os.path.isdir(path):
        pytest.skip("test tables not present")
    return path


@pytest.fixture(scope="module")
def small(small_dir):
    return connect(small_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, small_dir, name):
    found = same(spark, small, small_dir, name)
    assert found == 0 if name.endswith("_empty") else found > 0


@pytest.fixture(scope="module")
def skewed_dir(spark, small_dir, tmp_path_factory):
    """One invoice and one track with a third of the lines, one customer with a third of the invoices."""
    out = str(tmp_path_factory.mktemp("skewed"))
    con = connect(small_dir)
    con.sql(
        f"""COPY (SELECT * REPLACE (CASE WHEN hash(l_orderkey, l_partkey, 1) % 3 = 0 THEN 7 ELSE l_orderkey END
        AS l_orderkey, CASE WHEN hash(l_orderkey, l_suppkey, 2) % 3 = 0 THEN 3 ELSE l_partkey END AS l_partkey)
        FROM lineitem) TO '{out}/lines.parquet'"""
    )
    con.sql(
        f"""COPY (SELECT * REPLACE (CASE WHEN hash(o_orderkey, 3) % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)
        FROM orders) TO '{out}/orders.parquet'"""
    )
    for table in ("region", "nation", "customer", "supplier", "part"):
        con.sql(f"COPY {table} TO '{out}/{table}.parquet'")
    spark.read.parquet(f"{out}/lines.parquet").repartition(8).write.parquet(f"{out}/lineitem.parquet")
    return out


@pytest.fixture(scope="module")
def other_days_dir(small_dir, tmp_path_factory):
    """Half the orders ten years earlier, a quarter thirty years later, quantities with fractions."""
    out = str(tmp_path_factory.mktemp("days"))
    con = connect(small_dir)
    moved = "to_years(CASE o_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN -30 ELSE 0 END)"
    con.sql(f"COPY (SELECT * REPLACE (o_orderdate - {moved} AS o_orderdate) FROM orders) TO '{out}/orders.parquet'")
    con.sql(f"COPY (SELECT * REPLACE (1.5::DOUBLE AS l_quantity) FROM lineitem) TO '{out}/lineitem.parquet'")
    for table in ("region", "nation", "customer", "supplier", "part"):
        con.sql(f"COPY {table} TO '{out}/{table}.parquet'")
    return out


@pytest.mark.parametrize(
    "name",
    [
        "invoice_details",
        "core_kpis",
        "group_kpis_genre",
        "group_kpis_country",
        "catalog_sales_genre",
        "group_yearly_genre",
        "top_groups_yearly",
        "monthly_summary",
        "geo_frames",
        "cohort_retention",
        "cohort_matrix",
        "retention_decay",
        "retention_decay_percent",
        "customer_metrics",
        "retention_kpis",
    ],
)
def test_no_day_of_the_data_is_cut(spark, other_days_dir, name):
    assert same(spark, connect(other_days_dir), other_days_dir, name) > 0


def test_all_invoices_and_fractions_count(spark, other_days_dir):
    mart = SalesMart(SalesModel.read_wholesale(spark, other_days_dir))
    row = mart.core_kpis().first()
    lines = mart.sales.agg({"num_lines": "sum"}).first()[0]
    assert row.purchases_num == mart.invoices.count()
    assert row.tracks_sold_num == 1.5 * lines
    months = [r[0] for r in mart.monthly_summary().collect()]
    assert months[0] < "1990" and months[-1] > "2020"


@pytest.mark.parametrize(
    "name",
    [
        "core_kpis_window",
        "group_kpis_artist",
        "group_yearly_genre",
        "catalog_sales_genre",
        "monthly_summary_window",
        "geo_frames_window",
        "cohort_retention_window",
        "retention_decay_window",
        "customer_metrics_window",
        "retention_kpis_window",
    ],
)
def test_query_equals_sql_on_skewed_tables(spark, skewed_dir, name):
    assert same(spark, connect(skewed_dir), skewed_dir, name) > 0


def test_skewed_join_partitions_are_split(spark, skewed_dir):
    """With small thresholds the hot track's partition is split when lines meet items."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings if k != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        staged = SalesMart(SalesModel.read_wholesale(spark, skewed_dir)).sales
        staged.collect()
        assert "skew=true" in staged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for key, value in before.items():
            spark.conf.set(key, value)


SPLITTING = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
}


def with_settings(spark, settings, run):
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        return run()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_hot_customer_is_split_with_the_nations_broadcast(spark, skewed_dir):
    """Raw invoices, from several files, meet the customers between plain shuffles."""
    tables = load_tables(spark, skewed_dir, WHOLESALE)
    tables |= {"nation": F.broadcast(tables["nation"]), "orders": tables["orders"].repartition(8)}
    model = SalesModel.from_wholesale(tables)
    none = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}

    def run():
        raw = model.with_country(model.invoice)
        raw.collect()
        return raw._jdf.queryExecution().executedPlan().toString()

    plan = with_settings(spark, SPLITTING | none, run)
    assert "BroadcastHashJoin" in plan and "skew=true" in plan


@pytest.mark.parametrize("name", ["core_kpis", "catalog_sales_genre", "group_yearly_genre"])
def test_a_hot_invoice_leaves_few_rows_to_the_join(spark, skewed_dir, name):
    """No more than one row per track, so no task of the join holds twice the mean."""
    model = SalesModel.read_wholesale(spark, skewed_dir)
    plan = QUERIES[name](spark, skewed_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan
    tracks = model.line.select("invoice_id", "track_id").distinct()
    tasks = collections.Counter(r[0] for r in tracks.select(F.pmod(F.hash("invoice_id"), F.lit(8))).collect())
    raw = collections.Counter(r[0] for r in model.line.select(F.pmod(F.hash("invoice_id"), F.lit(8))).collect())
    assert max(tasks.values()) < 2 * sum(tasks.values()) / 8 < max(raw.values())


@pytest.fixture(scope="module")
def years():
    return DateRange.of(date(1997, 1, 1), date(1998, 12, 31))


@pytest.mark.parametrize(
    ("flt", "core", "counts"),
    [
        (SalesFilter(), (4431, 1410, 62, 458828, 910548150.96, 6, 25, 25), (14743, 1410, 64, 1346, 52, 1175)),
        (CHOICE, (207, 106, 7, 25844, 50478696.78, 6, 25, 2), (643, 106, 26, 80, 19, 59)),
    ],
)
def test_known_figures(spark, tables_dir, years, flt, core, counts):
    mart = SalesMart(SalesModel.read_wholesale(spark, tables_dir), flt).persist()
    row = mart.core_kpis(years).first()
    assert core == (
        row.purchases_num,
        row.cust_num,
        row.cust_num_new,
        row.tracks_sold_num,
        row.revenue_total,
        row.genre_num,
        row.artist_num,
        row.country_num,
    )
    kept = mart.retention_kpis(years).first()
    assert counts == (
        mart.invoices.count(),
        kept.num_cust,
        kept.num_new,
        kept.ret_n_return,
        kept.ret_n_conv,
        kept.ret_n_window,
    )
    mart.unpersist()


PRUNED = [n for n in sorted(QUERIES) if n.endswith(("_filtered", "_window", "_empty")) and not n.startswith(("cohort", "retention", "customer", "top_cohorts", "bundle"))]


@pytest.mark.parametrize("name", PRUNED)
def test_query_equals_sql_with_lines_filtered_where_they_are_read(spark, small, small_dir, name):
    def run():
        found = same(spark, small, small_dir, name)
        assert found == 0 if name.endswith("_empty") else found > 0

    with_settings(spark, {LEAST_BYTES[0]: "0"}, run)


@pytest.mark.parametrize("name", ["group_yearly_artist_filtered", "core_kpis_window"])
def test_filtered_lines_of_skewed_tables(spark, skewed_dir, name):
    with_settings(spark, {LEAST_BYTES[0]: "0"}, lambda: same(spark, connect(skewed_dir), skewed_dir, name))
