"""Spark-native analytics over behavioural event streams and text corpora."""

__version__ = "0.1.0"
