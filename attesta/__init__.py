"""Spark-native verification of identity documents, and operators for training data."""
