"""Spark-native engine for encoding-model analytics."""
