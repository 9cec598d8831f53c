"""Spark-native document benchmark and training-data engine."""
