"""Spark-native engine for sparse finite-element and Bayesian inverse-problem analytics."""

__version__ = "0.1.0"
