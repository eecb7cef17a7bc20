"""Operators for large training-data pipelines: text in, decisions, packs and scores out."""
