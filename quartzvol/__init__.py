"""Spark-native time-series analytics and forecast evaluation."""
