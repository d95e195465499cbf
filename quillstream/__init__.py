"""Spark-native analytics over noisy symbol streams."""
