"""Spark-first engine for preparing, indexing and condensing text."""
