"""Spark-native analytics for places, crowd signals and social events."""
