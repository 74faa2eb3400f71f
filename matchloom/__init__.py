"""Spark-first matching, ranking and data-preparation engine."""
