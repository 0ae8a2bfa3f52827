"""Delivery analytics over time-aligned tables, as ordinary Spark operators."""

__version__ = "0.1.0"
