"""Spark-native analytics and machine-learning operators."""
