"""Spark-native analytics over agent and session telemetry."""

__version__ = "0.1.0"
