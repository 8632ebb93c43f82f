"""Prompt screening and audit analytics as Spark DataFrame jobs."""
