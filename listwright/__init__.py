"""Spark-native discovery, triage and digest of classified business listings."""
