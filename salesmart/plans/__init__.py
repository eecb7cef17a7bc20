"""Compositions of operators: the mart, the KPI bundle and the insight cards."""
