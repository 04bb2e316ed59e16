"""Spark-native open-data catalog engine: every operator takes and returns DataFrames."""
