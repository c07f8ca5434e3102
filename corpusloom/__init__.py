"""Spark-native text curation, retrieval and evaluation engine."""
