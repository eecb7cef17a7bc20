"""The metrics a result can be ranked or drawn by."""

# Metric columns and their labels.
METRICS = {
    "revenue": "Revenue (USD$)",
    "num_customers": "Number of Customers",
    "first_time_customers": "First-Time Customers",
    "num_purchases": "Number of Purchases",
    "tracks_sold": "Tracks Sold",
}


def check_metric(name: str) -> str:
    if name not in METRICS:
        raise KeyError(name)
    return name
