"""Spark-native analytics for security logs."""
