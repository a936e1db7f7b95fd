"""Spark-native evidence resolution and record assembly."""
