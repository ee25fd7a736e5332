"""Spark-native retrieval and evaluation engine."""
