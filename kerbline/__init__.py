"""Spark-native analytics over timestamped sensor observations."""
