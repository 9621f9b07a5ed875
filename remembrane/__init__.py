"""Spark-native analytics for temporal knowledge data."""
