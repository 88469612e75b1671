"""Spark-native page extraction engine."""
