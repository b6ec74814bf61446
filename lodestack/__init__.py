"""Spark-native workspace knowledge engine."""
