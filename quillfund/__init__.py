"""Spark-native analytics of fund data and training corpora."""
