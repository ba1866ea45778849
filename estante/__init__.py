"""Retrieval analytics on Spark: prepare, search and evaluate document collections."""

__version__ = "0.1.0"
