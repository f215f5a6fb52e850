"""Spark-native text analytics for corpora of research documents."""

__version__ = "0.1.0"
