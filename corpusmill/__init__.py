"""Spark-native preparation of machine-learning training data."""
