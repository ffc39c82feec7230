"""Spark-native analysis of multi-volume backup archives held as tables."""
