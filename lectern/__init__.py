"""Spark-native text and speech-segment quality analytics."""

__version__ = "0.1.0"
