"""Queries: operators applied to tables."""
