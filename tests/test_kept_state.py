"""State kept beside the tables: distinct sets, customer days, trees of ids; and medians with an error."""

from __future__ import annotations

import hashlib
import os
import random
from datetime import date

import pytest
from conftest import YEAR, rows
from plan_metrics import nodes
from pyspark.sql import functions as F

from salesmart import DateRange, SalesFilter, SalesMart, SalesModel
from salesmart.functions.id_tree import differing_ids, plain_digest, tree_digest
from salesmart.operators import retention
from salesmart.plans.customers import CustomerDays
from salesmart.plans.distinct import DistinctSets
from salesmart.plans.registry import mart_for

RANGES = [None, YEAR, DateRange.of("2010-01-31", "2010-02-01"), DateRange.of("2010-02-02", "2010-07-07"), DateRange.of("2009-05-10", "2011-02-19"), DateRange.of("1990-01-01", "1990-03-05")]


@pytest.mark.parametrize(
    ("start", "end", "whole"),
    [
        ("2010-01-01", "2010-12-31", ("2010-01-01", "2010-12-31")),
        ("2010-01-02", "2010-12-30", ("2010-02-01", "2010-11-30")),
        ("2010-01-31", "2010-02-28", ("2010-02-01", "2010-02-28")),
        ("2010-01-02", "2010-02-27", None),
        ("2012-12-15", "2013-03-01", ("2013-01-01", "2013-02-28")),
    ],
)
def test_whole_months_of_a_range(start, end, whole):
    found = DateRange.of(start, end).whole_months()
    assert found == (whole and DateRange.of(*whole))


@pytest.fixture(scope="module")
def sets(spark, model, tmp_path_factory):
    kept = DistinctSets(str(tmp_path_factory.mktemp("sets")))
    kept.write(SalesMart(model))
    return kept


@pytest.mark.parametrize("rng", RANGES)
@pytest.mark.parametrize("by", ["genre", "artist", "country"])
def test_counts_of_any_range_are_those_of_the_rows(spark, model, sets, by, rng):
    staged = SalesMart(model).invoices
    staged = staged if rng is None else staged.where(rng.contains("dt"))
    if by == "country":
        wanted = staged.groupBy(F.col("country").alias("group_val")).agg(F.count_distinct("customer_id"))
    else:
        lines = staged.join(model.line, "invoice_id").join(model.item, "track_id").where(F.col(by).isNotNull())
        wanted = lines.groupBy(F.col(by).alias("group_val")).agg(F.count_distinct("customer_id"), F.count_distinct("track_id"))
    assert sorted(rows(sets.counts(spark, by, rng))) == sorted(rows(wanted))


def test_no_range_reads_a_line_or_an_invoice(spark, sets):
    for rng in RANGES[:3]:
        found = sets.counts(spark, "genre", rng)
        found.collect()
        scans = [n for n in nodes(found._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "FileSourceScanExec"]
        paths = {n.relation().location().rootPaths().mkString(" ") for n in scans}
        assert paths and all(sets.folder in p for p in paths)
        assert len(paths) <= 2


def test_sets_of_nothing(spark, empty_mart, tmp_path):
    kept = DistinctSets(str(tmp_path / "none"))
    kept.write(empty_mart)
    assert rows(kept.counts(spark, "genre", YEAR)) == []


def far_apart(spark, days, per_day):
    """A model of customers and tracks whose ids hardly ever share a bucket."""
    rows = spark.range(days * per_day).select(
        F.col("id").alias("invoice_id"),
        (F.col("id") * 1_000_003 % 100_000_007 * 17).alias("customer_id"),
        F.date_add(F.lit("2010-01-20"), (F.col("id") % days).cast("int")).alias("dt"),
    )
    line = rows.select("invoice_id", F.col("customer_id").alias("track_id"), F.lit(1).cast("long").alias("quantity"), F.lit(1).cast("long").alias("amount"))
    item = line.select("track_id", F.lit("Rock").alias("genre_id"), F.lit("Rock").alias("genre"), F.lit("X").alias("artist_id"), F.lit("X").alias("artist"))
    return SalesModel(rows.withColumns({"country": F.lit("USA"), "invoice_date": F.col("dt"), "total": F.lit(1)}), line, item, item.select(F.col("genre").alias("name")), item.select(F.col("artist").alias("name")))


def test_sets_take_room_by_the_ids_they_hold(spark, tmp_path):
    folder, days, per_day = tmp_path / "sparse", 40, 250
    kept = DistinctSets(str(folder))
    kept.write(SalesMart(far_apart(spark, days, per_day)))
    size = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    # Five sets of days and of months hold every id once.
    assert size < 10 * days * per_day * 8
    assert rows(kept.counts(spark, "genre")) == [("Rock", days * per_day, days * per_day)]
    assert rows(kept.counts(spark, "country", DateRange.of("2010-01-25", "2010-02-10"))) == [("USA", 17 * per_day)]


def test_writing_sets_leaves_no_shuffle_table_or_setting_behind(spark, model, tmp_path):
    from salesmart.plans.distinct import WRITING

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(b.toString().startswith("shuffle_") and b.toString().endswith(".data") for b in (root.getAllBlocks().apply(k) for k in range(root.getAllBlocks().size())))
    before, chosen = held(), {key: spark.conf.get(key, None) for key in WRITING}
    tables = spark.catalog.listTables()
    kept = DistinctSets(str(tmp_path / "sets"))
    kept.write(SalesMart(model))
    assert held() <= before
    assert spark.catalog.listTables() == tables
    assert {key: spark.conf.get(key, None) for key in WRITING} == chosen
    assert sorted(os.listdir(kept.folder)) == ["day_words", "month_words"]


def test_full_thin_odd_and_missing_ids_are_counted(spark, tmp_path):
    """Ids of whole buckets, far ones, negative ones and none, on days that may be missing."""
    ids = [*range(1, 40_001), *range(-3, 1), 1 << 40, (1 << 62) + 5, None]
    people = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "invoice_id long, customer_id long")
    day = F.when(F.col("invoice_id") % 7 < 6, F.date_add(F.lit("2010-01-30"), (F.col("invoice_id") % 7).cast("int")))
    invoice = people.withColumn("dt", day).withColumn("country", F.when(F.col("invoice_id") % 11 > 0, "USA"))
    invoice = invoice.unionByName(invoice.where("invoice_id % 5 = 0")).withColumns({"invoice_date": F.col("dt"), "total": F.lit(1)})
    line = invoice.select("invoice_id", F.col("customer_id").alias("track_id"), F.lit(1).cast("long").alias("quantity"), F.lit(1).cast("long").alias("amount"))
    line = line.unionByName(line.limit(100).withColumn("invoice_id", F.lit(None).cast("long")))
    genre = F.when(F.col("track_id") % 3 == 0, "Rock").when(F.col("track_id") % 3 == 1, "Jazz")
    item = line.select("track_id", F.lit(1).alias("genre_id"), genre.alias("genre"), F.lit(1).alias("artist_id"), F.lit("X").alias("artist")).distinct()
    model = SalesModel(invoice, line, item, item.select(F.col("genre").alias("name")), item.select(F.col("artist").alias("name")))
    kept = DistinctSets(str(tmp_path / "odd"))
    kept.write(SalesMart(model))
    bought = SalesMart(model).invoices
    sold = bought.join(line, "invoice_id").join(item, "track_id")
    for rng in (None, DateRange.of("2010-01-31", "2010-02-02"), DateRange.of("2010-02-01", "2010-02-28")):
        within = F.lit(True) if rng is None else rng.contains("dt")
        for by in ("genre", "artist"):
            wanted = sold.where(within).where(F.col(by).isNotNull()).groupBy(by).agg(F.count_distinct("customer_id"), F.count_distinct("track_id"))
            assert sorted(rows(kept.counts(spark, by, rng))) == sorted(rows(wanted))
        wanted = bought.where(within).groupBy("country").agg(F.count_distinct("customer_id"))
        assert sorted(rows(kept.counts(spark, "country", rng)), key=str) == sorted(rows(wanted), key=str)


def test_customer_days_of_batches_are_those_of_all(spark, model, tmp_path):
    invoices = SalesMart(model).invoices
    days = CustomerDays(str(tmp_path / "days"))
    days.add("2009", invoices.where("dt < '2010-01-01'"))
    days.add("2010", invoices.where("dt >= '2010-01-01' AND invoice_id <> 6"))
    days.add("2010", invoices.where("dt >= '2010-01-01' AND invoice_id <> 6"))  # run again
    days.add("late", invoices.where("invoice_id = 6"))  # a second purchase of a day that is there
    for rng in (None, YEAR, DateRange.of("2010-07-01", "2010-07-31")):
        wanted = sorted(rows(retention.customer_bounds(invoices, rng)))
        assert sorted(rows(days.bounds(spark, rng))) == wanted
        assert sorted(rows(days.metrics(spark, rng)), key=str) == sorted(rows(retention.customer_metrics(retention.customer_bounds(invoices, rng), rng)), key=str)
    merged = days.merge("all", str(tmp_path / "merged"))
    assert os.listdir(merged.folder).count("batch=all") == 1
    assert sorted(rows(merged.bounds(spark, YEAR))) == sorted(rows(days.bounds(spark, YEAR)))
    with pytest.raises(ValueError):
        days.add("../elsewhere", invoices)


def test_another_day_reads_no_old_invoice(spark, tables_dir, tmp_path):
    """State of days 1 to n plus day n + 1 is the state of all days."""
    mart = mart_for(spark, tables_dir, SalesFilter())
    last = mart.invoices.agg(F.max("dt")).first()[0]
    days = CustomerDays(str(tmp_path / "days"))
    days.add("before", mart.invoices.where(F.col("dt") < F.lit(last)))
    days.add(last.isoformat(), mart.invoices.where(F.col("dt") == F.lit(last)))
    found = days.bounds(spark)
    wanted = mart.customer_bounds()
    assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
    assert isinstance(last, date) and "o_orderdate" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_changed_id_among_many_is_found(spark):
    ids = spark.range(0, 600_000, 3)
    other = ids.where("id <> 299997").unionByName(spark.createDataFrame([(299_998,)], "id long")).repartition(7)
    assert tree_digest(ids, "id").first()[0] == tree_digest(other, "id").first()[0] == 200_000
    assert tree_digest(ids, "id").first() != tree_digest(other, "id").first()
    assert sorted(map(tuple, differing_ids(ids, other, "id").collect())) == [(299_997, True), (299_998, False)]
    assert differing_ids(ids, ids.repartition(5), "id").collect() == []


def test_identity_ignores_order_copies_and_nulls(spark):
    draw = random.Random(4)
    ids = [draw.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + [0, -1, 4095, 4096, -4096, -4097]
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    other = spark.createDataFrame([(i,) for i in [None, *ids, *ids[:9]]], "id long").repartition(6)
    assert tree_digest(frame, "id").collect() == tree_digest(other, "id").collect()
    assert plain_digest(frame, "id").first()[0] == plain_digest(other, "id").first()[0] == hashlib.md5(",".join(sorted(map(str, ids))).encode()).hexdigest()
    assert differing_ids(frame, other.where("id > 0 OR id IS NULL"), "id").count() == sum(i <= 0 for i in ids)
    nothing = frame.limit(0)
    assert tuple(tree_digest(nothing, "id").first()) == (0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("error", [0.1, 0.01, 0.001])
def test_approximate_medians_keep_their_rank_error(spark, error):
    skewed = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * F.col("id")) % 4999).cast("double").alias("x")).cache()
    found = skewed.agg(retention.median("x", error)).first()[0]
    below, until = skewed.where(F.col("x") < found).count(), skewed.where(F.col("x") <= found).count()
    assert below <= (0.5 + error) * 20_000 and until >= (0.5 - error) * 20_000


def test_medians_are_exact_unless_an_error_is_allowed(mart):
    exact, near = mart.retention_kpis(YEAR).first(), mart.retention_kpis(YEAR, rank_error=1e-4).first()
    assert exact["num_cust"] == near["num_cust"] and exact["avg_gap_life"] == near["avg_gap_life"]
    assert near["med_gap_life"] is not None
    with pytest.raises(ValueError):
        mart.retention_kpis(YEAR, rank_error=2)
