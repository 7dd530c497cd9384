"""Spark analytics for transit reliability and the records kept around it."""

__version__ = "0.1.0"
