"""Spark-native secret scanning and corpus preparation."""
