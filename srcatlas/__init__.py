"""Spark-native indexing, linking, retrieval and cleaning of source-code corpora."""

__version__ = "0.1.0"
