"""Spark-native analytics over tabular time series and document collections."""
