"""Tables laid out so that invoices and their lines meet without a shuffle.

Both are written in the same number of buckets by invoice, so sums per invoice and joins on
it stay within a bucket. Lines carry the names of their item's genre and artist, so a filter
on these needs no join either. A bucket is one task when it is read, and an invoice may hold
a large share of all lines: lines are first reduced to one row per invoice and track, with
their number, so that no invoice has more rows than the catalog has tracks.

Buckets belong to tables of the session's catalog, not to files. Reading a layout registers
the tables over its files, so any later session can use it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesmart.functions.key_filter import told_bytes
from salesmart.sources.model import SalesModel
from salesmart.sources.shared import removed

BUCKETED = ("invoice", "line")
LABELS = ("genre_id", "genre", "artist_id", "artist")
BUCKET_BYTES = 128 << 20
TOLD = "layout"


def buckets_for(model: SalesModel) -> int:
    """A bucket per 128 MB of lines, and no fewer than the session has shuffle partitions."""
    partitions = int(model.line.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, (told_bytes(model.line) or 0) // BUCKET_BYTES)


def write_layout(model: SalesModel, folder: str, buckets: int | None = None) -> None:
    """Write all views of a model below a new folder."""
    spark, folder = model.line.sparkSession, folder.rstrip("/")
    buckets = buckets or buckets_for(model)
    reduced = model.line.groupBy("invoice_id", "track_id").agg(
        model.line_count.alias("lines"), F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount")
    )
    labels = model.item.select("track_id", *LABELS)
    frames = {"invoice": model.invoice, "line": reduced.join(labels, "track_id", "left"), "item": model.item, "genre": model.genre, "artist": model.artist}
    if model.homes is not None:
        frames["homes"] = model.homes
    for name, df in frames.items():
        if name in BUCKETED:
            # Bucket k is the k-th partition, so each bucket is one file.
            dealt = df.repartition(buckets, "invoice_id").write.bucketBy(buckets, "invoice_id").sortBy("invoice_id")
            dealt.format("parquet").option("path", f"{folder}/{name}").saveAsTable(_table(folder, name))
        else:
            df.write.parquet(f"{folder}/{name}")
    told = json.dumps({"buckets": buckets, "schemas": {name: df.schema.json() for name, df in frames.items()}})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{folder}/{TOLD}")


def read_layout(spark: SparkSession, folder: str) -> SalesModel:
    """The model over a layout; a missing one raises Spark's path-not-found error."""
    folder = folder.rstrip("/")
    told = json.loads(spark.read.text(f"{folder}/{TOLD}").first()[0])
    frames = {name: _read(spark, folder, name, schema, told["buckets"]) for name, schema in told["schemas"].items()}
    return SalesModel(**frames, labelled=True)


@contextmanager
def sold_by_invoice(model: SalesModel, invoices: DataFrame, folder: str) -> Iterator[tuple[SalesModel, DataFrame]]:
    """What is on some invoices, for as long as it takes to ask for all of it.

    Written into a new folder, in buckets by invoice: the invoices with their customer and
    day, and the items on lines, once per invoice and track, with genre and artist but
    without what they sold for. Lines of other invoices may be among them. When the results
    are written, the folder goes.
    """
    spark, folder, buckets = model.line.sparkSession, folder.rstrip("/"), buckets_for(model)
    # Joined first, the rows of an invoice are made distinct where those of a track lie.
    sold = model.line.select("invoice_id", "track_id").where("invoice_id IS NOT NULL")
    sold = sold.join(model.item.select("track_id", "genre", "artist"), "track_id").distinct()
    try:
        held = _dealt(invoices.select("invoice_id", *model.customer_keys, "dt"), folder, "invoice", buckets)
        line = model.line
        if not model.labelled:
            line = _dealt(sold, folder, "line", buckets)
            line = line.withColumns({"quantity": F.lit(None).cast("double"), "amount": F.lit(None).cast("long")})
        yield replace(model, line=line, labelled=True), held
    finally:
        for name in BUCKETED:
            spark.sql(f"DROP TABLE IF EXISTS {_table(folder, name)}")
        removed(spark, folder)


def _dealt(df: DataFrame, folder: str, name: str, buckets: int) -> DataFrame:
    """Rows as a table in buckets by invoice."""
    table = _bucketed(df.sparkSession, folder, name, df.schema, buckets)
    df.repartition(buckets, "invoice_id").write.insertInto(table)
    return df.sparkSession.table(table)


def _read(spark: SparkSession, folder: str, name: str, schema: str, buckets: int) -> DataFrame:
    kind = StructType.fromJson(json.loads(schema))
    if name not in BUCKETED:
        return spark.read.schema(kind).parquet(f"{folder}/{name}")
    return spark.table(_bucketed(spark, folder, name, kind, buckets))


def _bucketed(spark: SparkSession, folder: str, name: str, kind: StructType, buckets: int) -> str:
    """The name of a table in buckets by invoice, registered if it is not."""
    table = _table(folder, name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY (invoice_id) SORTED BY (invoice_id) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'"
    )
    return table


def _table(folder: str, name: str) -> str:
    return f"salesmart_{hashlib.sha256(folder.encode()).hexdigest()[:16]}_{name}"
