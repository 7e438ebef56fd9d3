"""Spark-native analytics for industrial-control telemetry."""
