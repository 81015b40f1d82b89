"""Spark-native interferometry analytics: visibility, gain, pixel and catalogue tables as DataFrames."""
