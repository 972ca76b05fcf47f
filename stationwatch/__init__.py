"""Spark-native fault and anomaly analytics for networks of fixed sensors."""

__version__ = "0.1.0"
