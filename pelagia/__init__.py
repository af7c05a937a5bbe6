"""Spark-native operators for sequence-search evidence and spatial community ecology."""
