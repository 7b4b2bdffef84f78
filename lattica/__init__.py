"""Spark-native tabular and panel analytics."""
