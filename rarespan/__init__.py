"""Spark-native redundancy and coverage analytics."""
