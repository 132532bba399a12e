"""Batch analytics for fleet telemetry, planned by Spark."""
