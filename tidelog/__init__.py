"""Partitioned event-log analytics on PySpark."""
