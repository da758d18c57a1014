"""Spark-native retrieval, text-analytics and training-data engine."""
