"""Spark-native near-duplicate image engine and its corpus operators."""

__version__ = "1.0.0b1"
