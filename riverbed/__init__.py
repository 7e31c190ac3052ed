"""Spark-native analytics over document streams, events and versioned series."""
