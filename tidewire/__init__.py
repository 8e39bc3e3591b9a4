"""Spark-native analytics for multi-source document streams."""
