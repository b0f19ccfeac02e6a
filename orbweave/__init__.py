"""Spark-native spatio-temporal analytics engine."""
