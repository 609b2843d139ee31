"""Spark-native analytics for coordinated abuse in transaction streams."""
