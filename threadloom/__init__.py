"""Spark-native engine for question-and-answer style records."""

__version__ = "0.1.0"
