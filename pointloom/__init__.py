"""Spark-first analytics for very large spatial point collections."""

__version__ = "0.1.0"
