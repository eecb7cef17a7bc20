"""Column types of the source tables, limited to the columns the model reads.

Declaring them keeps reads free of schema inference and narrows every scan.
"""

# Store tables: invoices, their lines, and the track catalog.
STORE = {
    "Invoice": (
        "InvoiceId long, CustomerId long, InvoiceDate timestamp_ntz, "
        "BillingCountry string, Total decimal(10,2)"
    ),
    "InvoiceLine": "InvoiceId long, TrackId long, Quantity int, UnitPrice decimal(10,2)",
    "Track": "TrackId long, AlbumId long, GenreId long",
    "Album": "AlbumId long, ArtistId long",
    "Artist": "ArtistId long, Name string",
    "Genre": "GenreId long, Name string",
}

# Wholesale tables: orders with line items, parts and customers.
WHOLESALE = {
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_quantity double, "
        "l_extendedprice double, l_discount double"
    ),
    "part": "p_partkey long, p_brand string, p_type string",
    "customer": "c_custkey long, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
}
