"""Spark-native text-corpus, annotation and embedding analytics."""
