"""Queries over the given tables, and the same results in SQL for comparison."""
