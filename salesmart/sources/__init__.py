"""Table readers, the canonical sales model, and the CSV sink."""
