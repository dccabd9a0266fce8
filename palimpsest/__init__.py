"""Spark-native analytics for text fidelity: splitting, retrieval, scoring, auditing and statistics as DataFrame plans."""

__version__ = "0.1.0"
