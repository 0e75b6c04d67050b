"""Guarded analytics on Spark: checked statements, traceable answers, data jobs."""
