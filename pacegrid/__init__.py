"""Walkable-network analytics on Spark: scoring, spatial joins, series, routing, streams."""
