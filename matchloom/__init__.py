"""Spark-first analytics for matching people to jobs, and for the data work around it."""
