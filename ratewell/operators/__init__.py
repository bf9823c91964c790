"""Joins, aggregations and rankings over evaluation tables."""
