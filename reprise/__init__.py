"""Spark-native audit of photo evidence reused across field reports."""
