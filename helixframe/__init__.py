"""Spark-native feature-attribution analytics: every operator takes and returns DataFrames."""
