"""Posting search, ranking and tracking as PySpark DataFrame operators."""
