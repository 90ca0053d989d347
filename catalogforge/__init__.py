"""Catalogue building on Spark: read inconsistent exports, clean, index, browse."""

__version__ = "0.1.0"
