"""Spark-first analytics for tables of objects that are followed through time."""
