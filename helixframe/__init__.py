"""Spark-native analytics for loosely structured records and biological sequences."""

__version__ = "0.1.0"
