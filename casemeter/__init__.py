"""Spark-native evaluation analytics: prepare labelled cases, split them without
leakage, score and compare decision models, and audit the results."""

__version__ = "0.1.0"
