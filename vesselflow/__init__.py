"""Vessel telemetry on Spark."""
