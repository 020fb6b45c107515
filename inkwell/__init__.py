"""Spark-native engine for editorial document records."""
