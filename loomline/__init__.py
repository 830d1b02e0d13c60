"""Spark-native document, retrieval and usage analytics."""
