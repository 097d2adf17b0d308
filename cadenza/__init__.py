"""Spark-native analytics for ordered, timed text."""
