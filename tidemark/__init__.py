"""Tidemark: a PySpark-native engine for dated text, price and network data."""

__version__ = "0.1.0"
