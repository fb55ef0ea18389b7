"""Spark-native operators for preparing, checking and monitoring data."""
