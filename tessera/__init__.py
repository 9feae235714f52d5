"""Tessera: a PySpark-native retrieval-analytics engine."""

__version__ = "0.1.0"
