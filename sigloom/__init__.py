"""Spark-native signal analytics: features, windows, corpus splits, votes, metrics and calls as DataFrame operators."""

__version__ = "0.1.0"
