"""Audience and location analytics over cell-signal records, on PySpark."""
