"""Spark-native archive analytics and training-data operators."""
