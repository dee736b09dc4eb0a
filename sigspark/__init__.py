"""Spark-native approximate pattern search over large document collections."""

__version__ = "0.1.0"
