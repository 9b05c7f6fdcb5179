"""Spark-native analytics for continuous sample streams and triggered event records."""

__version__ = "0.1.0"
