"""Spark-native analytics engine for labelled corpora."""
