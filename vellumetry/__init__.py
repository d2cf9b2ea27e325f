"""Spark-native table profiling, data-quality and ML-readiness engine."""

__version__ = "0.1.0"
