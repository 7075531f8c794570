"""Spark-native sequence analytics."""
