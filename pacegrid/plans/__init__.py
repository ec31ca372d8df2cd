"""Queries: operators applied to the bound views, with their oracles."""
