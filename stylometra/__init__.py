"""Spark-first analytics over text and group-structured data."""
