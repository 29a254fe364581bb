"""Spark-native engine for message streams, event histories and training corpora."""
