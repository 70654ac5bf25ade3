"""Ratelathe: a Spark-native engine for explicit-rating analytics."""

__version__ = "0.1.0"
