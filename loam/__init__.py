"""Spark-native retrieval analytics: declarative operators over DataFrames."""

__version__ = "0.1.0"
