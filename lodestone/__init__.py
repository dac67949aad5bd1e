"""Retrieval over text, code and logs as Spark DataFrame jobs."""
