"""The canonical sales model every operator reads.

==========  =======================================================================
view        columns
==========  =======================================================================
invoice     invoice_id (unique), customer_id, invoice_date, dt, total; country where it is
            known per invoice
homes       customer_id (unique), country, where it is known per customer; else absent
line        invoice_id, track_id, quantity, amount; where ``labelled``, one row per invoice
            and track instead, with lines, their number, and the columns of the item
item        track_id (unique), genre_id, genre, artist_id, artist (names nullable)
genre       name
artist      name
==========  =======================================================================

``amount`` is a whole number of ten-thousandths, so that sums are exact and do not
depend on the order of tasks. ``quantity`` keeps the kind of its source: a fraction is not
cut off, and sums of whole numbers are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.money import units_of_decimal, units_of_double
from salesmart.sources.schemas import STORE, WHOLESALE
from salesmart.sources.tables import load_tables


@dataclass(frozen=True)
class SalesModel:
    invoice: DataFrame
    line: DataFrame
    item: DataFrame
    genre: DataFrame
    artist: DataFrame
    homes: DataFrame | None = None
    labelled: bool = False

    @property
    def line_count(self) -> Column:
        """How many lines there are, as an aggregate over rows of ``line``."""
        return F.sum("lines") if self.labelled else F.count(F.lit(1))

    @property
    def customer_keys(self) -> list[str]:
        """What to reduce invoices to customers by, so that the country can still be told."""
        return ["customer_id"] if self.homes is not None else ["customer_id", "country"]

    def with_country(self, rows: DataFrame) -> DataFrame:
        """Add the country to rows with a customer.

        Rows already reduced to a few per customer have no hot key. Raw invoices may; there
        nothing stands between the shuffle of either side and the join, so adaptive
        execution can split them.
        """
        return rows if self.homes is None else rows.join(self.homes, "customer_id", "left")

    @classmethod
    def read_store(cls, spark: SparkSession, directory: str) -> SalesModel:
        return cls.from_store(load_tables(spark, directory, STORE))

    @classmethod
    def read_wholesale(cls, spark: SparkSession, directory: str) -> SalesModel:
        return cls.from_wholesale(load_tables(spark, directory, WHOLESALE))

    @classmethod
    def from_store(cls, tables: dict[str, DataFrame]) -> SalesModel:
        """Invoices over a track catalog with albums, artists and genres."""
        invoice = tables["Invoice"].select(
            F.col("InvoiceId").alias("invoice_id"),
            F.col("CustomerId").alias("customer_id"),
            F.col("InvoiceDate").alias("invoice_date"),
            F.to_date("InvoiceDate").alias("dt"),
            F.col("BillingCountry").alias("country"),
            F.col("Total").alias("total"),
        )
        line = tables["InvoiceLine"].select(
            F.col("InvoiceId").alias("invoice_id"),
            F.col("TrackId").alias("track_id"),
            F.col("Quantity").cast("long").alias("quantity"),
            (F.col("Quantity") * units_of_decimal(F.col("UnitPrice"))).alias("amount"),
        )
        # Left joins: a track without a genre or an artist stays in the catalog.
        genre = tables["Genre"].select(F.col("GenreId"), F.col("Name").alias("genre"))
        artist = tables["Artist"].select("ArtistId", F.col("Name").alias("artist"))
        makers = tables["Album"].join(artist, "ArtistId").select("AlbumId", "ArtistId", "artist")
        item = (
            tables["Track"]
            .join(genre, "GenreId", "left")
            .join(makers, "AlbumId", "left")
            .select(
                F.col("TrackId").alias("track_id"),
                F.col("GenreId").alias("genre_id"),
                "genre",
                F.col("ArtistId").alias("artist_id"),
                "artist",
            )
        )
        return cls(
            invoice,
            line,
            item,
            tables["Genre"].select(F.col("Name").alias("name")),
            tables["Artist"].select(F.col("Name").alias("name")),
        )

    @classmethod
    def from_wholesale(cls, tables: dict[str, DataFrame]) -> SalesModel:
        """Orders as invoices, parts as tracks: part type is the genre, brand the artist."""
        nation = tables["nation"].select("n_nationkey", F.col("n_name").alias("country"))
        homes = (
            tables["customer"]
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("customer_id"), "country")
        )
        invoice = tables["orders"].select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("invoice_date"),
            F.to_date("o_orderdate").alias("dt"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        )
        line = tables["lineitem"].select(
            F.col("l_orderkey").alias("invoice_id"),
            F.col("l_partkey").alias("track_id"),
            F.col("l_quantity").cast("double").alias("quantity"),
            units_of_double(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        )
        item = tables["part"].select(
            F.col("p_partkey").alias("track_id"),
            F.col("p_type").alias("genre_id"),
            F.col("p_type").alias("genre"),
            F.col("p_brand").alias("artist_id"),
            F.col("p_brand").alias("artist"),
        )
        return cls(
            invoice,
            line,
            item,
            tables["part"].select(F.col("p_type").alias("name")).distinct(),
            tables["part"].select(F.col("p_brand").alias("name")).distinct(),
            homes,
        )
