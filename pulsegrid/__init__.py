"""Spark-native clinical telemetry analytics."""
