"""Spark-native evidence analytics."""
