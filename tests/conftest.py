from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from salesmart import DateRange, SalesFilter, SalesMart, SalesModel  # noqa: E402
from salesmart.session import configure  # noqa: E402

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def tables_dir():
    path = os.path.join(TESTDATA, "sf0.01")
    if not os.path.isdir(path):
        pytest.skip("test tables not present")
    return path


YEAR = DateRange.of("2010-01-01", "2010-12-31")

# One customer per retention branch around the window 2010, plus catalog corner cases.
#   A before, in and after; B once in; C twice on one day; D twice in, once after;
#   E once before, twice in; F only before; G across a month end, second invoice without
#   lines; H buys only an item without genre; I buys it together with a rock track.
INVOICES = [
    (1, "A", "2009-05-10", "USA", "10.00"),
    (2, "A", "2010-06-15", "USA", "4.00"),
    (3, "A", "2011-02-20", "USA", "2.00"),
    (4, "B", "2010-03-03", "France", "1.00"),
    (5, "C", "2010-07-07", "France", "3.00"),
    (6, "C", "2010-07-07", "Brazil", "3.00"),
    (7, "D", "2010-01-31", "USA", "1.00"),
    (8, "D", "2010-02-01", "USA", "1.00"),
    (9, "D", "2011-04-01", "USA", "1.00"),
    (10, "E", "2009-12-31", "Brazil", "1.00"),
    (11, "E", "2010-10-01", "Brazil", "1.00"),
    (12, "E", "2010-11-30", "Brazil", "1.00"),
    (13, "F", "2009-01-01", "Atlantis", "1.00"),
    (14, "G", "2010-01-31", "USA", "1.00"),
    (15, "G", "2010-02-01", "USA", "9.00"),
    (16, "H", "2010-05-05", "USA", "1.00"),
    (17, "I", "2010-05-05", "USA", "2.00"),
]
# Tracks: 1 rock/x, 2 jazz/y, 3 no genre/x, 4 rock/z (never sold), 5 rock/no artist.
LINES = [
    (1, 1, 1, "1.00"),
    (2, 1, 2, "1.00"),
    (2, 2, 1, "2.00"),
    (3, 2, 1, "2.00"),
    (4, 1, 1, "1.00"),
    (5, 2, 1, "2.00"),
    (6, 1, 3, "1.00"),
    (7, 1, 1, "1.00"),
    (8, 1, 1, "1.00"),
    (9, 1, 1, "1.00"),
    (10, 2, 1, "1.00"),
    (11, 2, 1, "1.00"),
    (12, 2, 1, "1.00"),
    (13, 1, 1, "1.00"),
    (14, 1, 1, "1.00"),
    (16, 3, 1, "1.00"),
    (17, 1, 1, "1.00"),
    (17, 3, 1, "1.00"),
]
TRACKS = [(1, 1, 1), (2, 2, 2), (3, 1, None), (4, 3, 1), (5, None, 1)]
ALBUMS = [(1, 1), (2, 2), (3, 3)]
ARTISTS = [(1, "X"), (2, "Y"), (3, "Z")]
GENRES = [(1, "Rock"), (2, "Jazz"), (3, "Opera")]


@pytest.fixture(scope="session")
def store_tables(spark):
    """The store tables of the hand-made fixture."""
    when = lambda day: datetime.fromisoformat(day)
    customers = {name: i for i, name in enumerate("ABCDEFGHI", start=1)}
    invoices = [(i, customers[c], when(d), k, t) for i, c, d, k, t in INVOICES]
    return {
        "Invoice": spark.createDataFrame(
            invoices,
            "InvoiceId long, CustomerId long, InvoiceDate timestamp_ntz, BillingCountry string, Total string",
        ).withColumn("Total", F.col("Total").cast("decimal(10,2)")),
        "InvoiceLine": spark.createDataFrame(
            LINES, "InvoiceId long, TrackId long, Quantity int, UnitPrice string"
        ).withColumn("UnitPrice", F.col("UnitPrice").cast("decimal(10,2)")),
        "Track": spark.createDataFrame(TRACKS, "TrackId long, AlbumId long, GenreId long"),
        "Album": spark.createDataFrame(ALBUMS, "AlbumId long, ArtistId long"),
        "Artist": spark.createDataFrame(ARTISTS, "ArtistId long, Name string"),
        "Genre": spark.createDataFrame(GENRES, "GenreId long, Name string"),
    }


@pytest.fixture(scope="session")
def model(store_tables):
    return SalesModel.from_store(store_tables)


@pytest.fixture(scope="session")
def mart(model):
    return SalesMart(model).persist()


@pytest.fixture(scope="session")
def empty_mart(model):
    """A filter that matches nothing: an artist without sales."""
    return SalesMart(model, SalesFilter(artists=("Z",)))


@pytest.fixture(scope="session")
def codes(spark):
    return spark.createDataFrame(
        [("USA", "US", "USA", "United States"), ("France", "FR", "FRA", "France"), ("Brazil", "BR", "BRA", "Brazil")],
        "country string, iso2 string, iso3 string, label string",
    )


def rows(df, *columns):
    """Rows as tuples, of the given columns if any."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
